"""The corpus pipeline's stages, as the driver looks for them; they are written in cladewise/llm/pipeline.py and go with it."""

from __future__ import annotations

from cladewise.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's; where neither is set, a folder in the warehouse, which all executors see as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        folder = folder or held.get()
    else:
        folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cladewise-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/cladewise-{label}-{uuid.uuid4().hex}"

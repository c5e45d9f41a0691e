"""Multi-party perspective rotation: every speaker's view of a dialogue, in DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the assistant and all others as named
users; system turns stay system turns and have no view of their own. Masks are the ranges of characters of
the rendered dialogue that the assistant wrote, each with its end mark, so training can be limited to them.

A view comes in segments of SEGMENT turn numbers with running offsets, so a conversation of any length never
meets in one task: only its segments' lengths do. A segment's text starts at `offset` of the whole view; the
joined segments are the view.

Defined results: null text is empty; a null or empty role is the participant "unknown"; a null turn comes
before all others; turns of one number are ordered by role and text, and repeated rows stay repeated; a
conversation of system turns alone has no view; a null conversation is a conversation; "<|" in a text becomes
"< |", so that no text forges a mark; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
SYSTEM = ("system",)
END = "<|end|>"


def _head(role: Column, speaker: Column, system: tuple[str, ...]) -> Column:
    named = F.concat(F.lit("<|user "), role, F.lit("|>\n"))
    return F.when(role.isin(*system), F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(named)


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: tuple[str, ...] = SYSTEM, segment: int = SEGMENT) -> DataFrame:
    """conv, speaker, segment, offset, n_turns, text, masks (array of start and end within the whole view)."""
    named = F.coalesce(F.nullif(F.col(role_col), F.lit("")), F.lit("unknown"))
    clean = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.floor(F.col(turn_col) / F.lit(segment)).alias("segment"), F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), F.replace(named, F.lit("|>"), F.lit("| >")).alias("role"), clean.alias("text")).alias("item")
    )
    segments = rows.groupBy("conv", "segment").agg(F.array_sort(F.collect_list("item")).alias("items"))
    speakers = rows.where(~F.col("item.role").isin(*system)).select(F.col("conv").alias("_conv"), F.col("item.role").alias("speaker")).distinct()
    both = segments.join(speakers, F.col("conv").eqNullSafe(F.col("_conv")))
    # One pass over a segment's turns: text, and the ranges of the assistant's turns.
    speaker = F.col("speaker")
    heads = F.transform("items", lambda x: F.struct(_head(x["role"], speaker, system).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), (x["role"] == speaker).alias("own")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        spans = F.when(x["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).cast("bigint").alias("at"), spans.alias("spans"))

    both = both.withColumn("parts", heads).withColumn("state", F.aggregate("parts", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step))
    both = both.select("conv", "speaker", "segment", F.size("items").cast("long").alias("n_turns"), F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"), F.col("state.at").alias("n"), F.col("state.spans").alias("spans"))
    before = Window.partitionBy("conv", "speaker").orderBy(F.col("segment").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    masks = F.transform("spans", lambda s: F.struct((s["start"] + F.col("offset")).alias("start"), (s["end"] + F.col("offset")).alias("end")))
    return both.select("conv", "speaker", "segment", "offset", "n_turns", "text", masks.alias("masks"))


def flat(views: DataFrame) -> DataFrame:
    """perspectives() with the masks as text: "start:end start:end"."""
    return views.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))), " "))


#: The same in DuckDB SQL, over the table conversations.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(nullif(role, ''), 'unknown'), '|>', '| >') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS body, row_number() OVER () AS rn
  FROM conversations),
v AS (
  SELECT t.*, s.speaker,
         CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10) WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user ' || t.role || '|>' || chr(10) END AS head
  FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system') s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, body, rn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM v)
SELECT conv_id, speaker, CAST(floor(turn / 64) AS BIGINT) AS segment, CAST(min(pos) AS BIGINT) AS "offset", count(*) AS n_turns,
       string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(CASE WHEN role = speaker THEN CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(head) + length(body) + 7 AS BIGINT) AS VARCHAR) END, ' ' ORDER BY pos), '') AS masks
FROM p GROUP BY conv_id, speaker, floor(turn / 64)
"""

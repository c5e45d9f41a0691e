"""A training corpus from raw documents.

Each stage takes all rows that its predecessor kept. A stage's result is written as Parquet in the shared
folder and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash, mixing, quality, suffix
from .common import staged


#: Words of a passage, and the bytes that such a passage has at least; operator 6 alone keeps its own threshold.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the learnt threshold go."""
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return quality.score(rows, ranker, "row").where("predicted = 1").select("row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id; of repeated rows of that id, one. Rows without an id cannot be told apart and stay, once for each text."""
    found = minhash.near_duplicates(docs).where("kept or doc_id is null").select(F.col("doc_id").alias("_id"), F.col("component_id").alias("_component")).distinct()
    own = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return own.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of PASSAGE_WORDS words or more are cut out and n_chars follows; documents of which nothing is left go. Null text stays."""
    left = suffix.remove(docs, words=PASSAGE_WORDS, least=PASSAGE_BYTES).where("text is null or text <> ''")
    return left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType)) if "n_chars" in left.columns else left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes to its target; a document that is taken twice comes twice. A null source is a source, texts without words are never taken, an empty table stays empty; no text is cut, however long."""
    return mixing.mix(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row, repeated rows included; null text has no ids, a null source stays null, an empty table stays empty, and long texts are encoded whole."""
    columns = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    out = bpe.encode(columns, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "row", "text")
    return out.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL cannot express the learnt threshold, the estimate or the merges; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, html, importance, minhash, mixing, packing, pipeline, planes, quality, suffix, wand, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, speaker, segment, offset, n_turns, text, masks."""
    return chat.flat(chat.perspectives(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op2_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, rank, doc_id, score: the ten best documents for each whole document whose id is divisible by 20."""
    docs = _table(spark, sf_dir, "documents")
    return wand.search(docs, docs.where("doc_id % 20 = 0")).withColumnRenamed("id", "doc_id")


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return webp.features(webp.write_media(webp.media(_table(spark, sf_dir, "documents"))))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixing.sizes(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html.main_text(_table(spark, sf_dir, "pages"))


def _span_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, ranges, passages in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data = text.as_py().encode()
            runs = suffix.merged(ranges)
            kept = suffix.kept_bytes(data, runs)
            out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), suffix.without_passages(data, passages, pipeline.PASSAGE_WORDS)))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (by strings of 400 bytes), and text: what is left without repeated passages of 50 words, as in the pipeline."""
    found = suffix.marked_twice(_table(spark, sf_dir, "documents").select("doc_id", "text"), pipeline.PASSAGE_BYTES).select("id", "text", "ranges", "passages")
    return found.mapInArrow(_span_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return planes.read(planes.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = _table(spark, sf_dir, "documents")
    ranker = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, ranker).withColumn("held_out", quality.held_out()).select("doc_id", "held_out", "score", "predicted")


def op11_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    docs = _table(spark, sf_dir, "documents")
    gains = importance.fit(docs, _table(spark, sf_dir, "benchmark"))
    return importance.draw(importance.weigh(docs, gains)).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_block_max_wand": op2_block_max_wand,
    "op3_lossless_webp": op3_lossless_webp,
    "op4_mix_sources": op4_mix_sources,
    "op5_html_main_text": op5_html_main_text,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_byte_level_bpe": op7_byte_level_bpe,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_token_planes": op9_token_planes,
    "op10_quality_ranking": op10_quality_ranking,
    "op11_bounded_space_packing": op11_bounded_space_packing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

#: DuckDB SQL over whole tables, where SQL can express the operator.
ORACLE: dict[str, str] = {"op1_chat_perspectives": chat.ORACLE, "op12_importance_resampling": importance.ORACLE}

"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

A source's target is its share, by weight, of `total` times all sizes, but at most `most` times its own size;
what is beyond that is shared again by weight. Where the target is e whole epochs and a fraction f of the
source, every document is taken e times and the fraction by weighted sampling without replacement: a document
with weight w gets the key -ln(u) / w for a u in (0, 1) that is a hash of seed, id and text, and the smallest
keys are taken until their sizes come nearest to the fraction's budget.

No source is sorted as a whole. Keys fall into BINS ranges and each of these into BINS smaller ones; the sums
of the ranges tell in which range, and in which smaller one, a source's budget ends, and only that one is sorted.
Per-source cuts are then applied row by row; up to BROADCAST sources they are counted and sent to all tasks, so
that no row is shuffled by its source.

Defined results: null or wordless text has size 0 and is taken 0 times; a source without words has target 0;
a null source is a source of its own, after all others; repeated rows have one key and so are ranked
together, then by a running number; an empty table gives an empty result; other columns are kept by `mix`
and ignored by `plan`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, staged

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, MOST = 1.5, 2.0
#: Ranges of keys for each source, and of each range; the sums of one source's ranges are sorted in one task.
BINS = 4096
#: Sources whose cuts (a row of numbers each) may be broadcast; beyond, rows and cuts are joined by shuffles.
BROADCAST = 50_000
SEED = 20_240_501

#: Number of words, as the contract fixes it.
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Blanks, digits and signs; what is left of a text are letters of any script.
NO_LETTERS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalpha())


def quality_of(text: Column) -> Column:
    """Weight from 0.1 to 1: the share of letters of any script, so that tables, markup and symbols are taken later."""
    n = F.length(text)
    return F.when(n > 0, 0.1 + 0.9 * F.length(F.translate(text, NO_LETTERS, "")) / n).otherwise(F.lit(0.1))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int, *more: Column) -> DataFrame:
    """id, source, size, _key, _fine, _bin and what more is asked for; one scan."""
    text = F.col(text_col)
    # 53 bits of a hash, never 0 or 1.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11).cast("double") + 0.5) / F.lit(float(2**53))
    weight = quality_of(text) if weight is None else F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1e-9))
    out = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text).alias("size"), (-F.log(u) / weight).alias("_key"), *more)
    # No range is hot for any weight: the ranges widen as the keys' density falls.
    fine = F.floor(F.lit(float(BINS * BINS)) * (F.col("_key") / (1 + F.col("_key")))).cast("int")
    return out.withColumn("_fine", fine).withColumn("_bin", F.shiftright("_fine", BINS.bit_length() - 1))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size -> and target. One row for each source: capped shares by weight, found from the order of the caps."""
    by_source, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    # With all sources before this one at their caps, the rest share what is left; the level is right where it doesn't reach the next cap.
    left = F.sum("source_size").over(all_rows) * F.lit(float(min(total, most))) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / F.sum("_w").over(after))
    ranked = ranked.withColumn("_rank", F.row_number().over(order))
    level = F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_rank"))).over(all_rows)
    return ranked.select("source", "source_size", F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w"))).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts). rows: id, source, size, _key, _fine, _bin, staged without texts. cuts, one row for each source: source_size, target, epochs, and where the fraction ends (end_fine, last_key)."""
    rows = staged(keyed(docs, id_col, text_col, source_col, weight, seed), "mix")
    return rows, cut(cuts(rows, weights, total, most))


def cuts(rows: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, total, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    in_order = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(in_order), F.lit(0)))
    ends = bins.withColumnRenamed("source", "_s").join(goal, F.col("_s").eqNullSafe(F.col("source"))).where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("bin_size") > F.col("budget"))).select("source", "_bin", "before", "budget")
    # The same once more within that range; only the smaller range in which a budget ends is sorted. Rows of one key stay together.
    last = rows.where("size > 0").withColumnRenamed("source", "_s").withColumnRenamed("_bin", "_b").join(ends, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_b") == F.col("_bin")))
    last = last.select("source", "_fine", "_key", "size", "before", "budget")
    parts = last.groupBy("source", "_fine").agg(F.sum("size").alias("part_size"), F.first("before").alias("before"), F.first("budget").alias("budget"))
    parts = parts.withColumn("upto", F.col("before") + F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.where((F.col("upto") <= F.col("budget")) & (F.col("upto") + F.col("part_size") > F.col("budget"))).select(F.col("source").alias("_p"), F.col("_fine").alias("end_fine"), "upto")
    last = last.join(parts, F.col("source").eqNullSafe(F.col("_p")) & (F.col("_fine") == F.col("end_fine")))
    last = last.groupBy("source", "end_fine", "_key").agg(F.sum("size").alias("size"), F.first("upto").alias("before"), F.first("budget").alias("budget"))
    upto = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("end", F.col("before") + F.sum("size").over(upto))
    # A key is taken if that brings the sum nearer to the budget.
    nearest = last.groupBy("source").agg(F.max(F.when(F.col("end") - F.col("budget") < F.col("budget") - (F.col("end") - F.col("size")), F.col("_key"))).alias("last_key"), F.first("end_fine").alias("end_fine"))
    nearest = nearest.select(F.col("source").alias("_n"), "end_fine", "last_key")
    out = goal.join(nearest, F.col("source").eqNullSafe(F.col("_n")), "left")
    # Without an end range the budget is 0 or covers all.
    return out.select("source", "source_size", "target", "epochs", "end_fine", "last_key", ((F.col("budget") >= F.col("source_size")) & (F.col("source_size") > 0)).alias("all_of_it"))


def taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows with source_size, target and copies: how often the mix takes the row; rows without words are never taken."""
    ends = ends.withColumnRenamed("source", "_source")
    ends = F.broadcast(ends) if ends.count() <= BROADCAST else ends
    joined = rows.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    chosen = F.coalesce(F.col("all_of_it"), F.lit(False)) | F.coalesce(F.col("_fine") < F.col("end_fine"), F.lit(False)) | F.coalesce((F.col("_fine") == F.col("end_fine")) & (F.col("_key") <= F.col("last_key")), F.lit(False))
    copies = F.coalesce(F.col("epochs"), F.lit(0)) + F.when(chosen, 1).otherwise(0)
    return joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))


def sizes(docs: DataFrame, **options) -> DataFrame:
    """id, size, source_size, target, taken for each row."""
    rows, ends = plan(docs, **options)
    return taken(rows, ends).select("id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mixed rows themselves, with docs' columns: a row that is taken twice comes twice."""
    _, ends = plan(docs, id_col, text_col, source_col, seed=seed, **options)
    rows = keyed(docs, id_col, text_col, source_col, options.get("weight"), seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return taken(rows, ends).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")

"""Pairs of hosts per window: categories, counts over windows, summaries. One projection per family, no self-joins.

pairs: tree_id, w_start, w_end, host_1, host_2, adjacent, contiguous, paths12, paths21, nodes1, nodes2, ancestry, dist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MIRROR = {"anc": "desc", "desc": "anc", "multiAnc": "multiDesc", "multiDesc": "multiAnc"}
CATEGORIES = (
    "proximity_3_way_cat", "any_ancestry_cat", "close_x_contiguous_cat", "close_and_adjacent_cat", "close_and_contiguous_cat", "close_and_adjacent_and_ancestry_cat",
    "close_and_contiguous_and_ancestry_cat", "close_and_adjacent_and_directed_cat", "close_and_contiguous_and_directed_cat",
)


def oriented(pairs: DataFrame) -> DataFrame:
    """host_1 < host_2: swapped pairs have mirrored ancestry, paths and nodes."""
    swap = F.col("host_2") < F.col("host_1")
    mirrored = F.coalesce(F.create_map(*[F.lit(x) for kv in _MIRROR.items() for x in kv])[F.col("ancestry")], F.col("ancestry"))
    two = [("host_1", "host_2"), ("paths12", "paths21"), ("nodes1", "nodes2")]
    changed = {a: F.when(swap, F.col(b)).otherwise(F.col(a)) for x, y in two for a, b in ((x, y), (y, x))}
    return pairs.withColumns(changed | {"ancestry": F.when(swap, mirrored).otherwise(F.col("ancestry"))})


def with_distance(pairs: DataFrame, dist: str = "min_dist", const: str = "norm_const") -> DataFrame:
    """patristic distance: the raw one by the tree's constant; the same for all trees."""
    return pairs.withColumn("dist", F.col(dist) / F.col(const))


def merged(windows: Sequence[DataFrame], constants: DataFrame | None = None, key: str = "tree_id") -> DataFrame:
    """Classifications of several windows as one table of pairs with host_1 < host_2 and dist.

    Their columns may differ: ancestry may be called path_classification, and a window may have a normalised distance
    (norm_min_dist) or none; without it dist is min_dist over the tree's norm_const (key, norm_const; 1 without one).
    A pair of one host, a missing distance or path count, and a pair that comes twice in a tree are errors of the
    input and stop the run.
    """
    rows = None
    for one in windows:
        one = one.withColumnRenamed("path_classification", "ancestry") if "path_classification" in one.columns else one
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if constants is not None:
        rows = rows.join(constants.select(key, F.col("norm_const").alias("_const")), key, "left")
    raw = F.col("min_dist") / (F.coalesce(F.col("_const"), F.lit(1.0)) if constants is not None else F.lit(1.0))
    rows = rows.withColumn("dist", F.coalesce(F.col("norm_min_dist"), raw) if "norm_min_dist" in rows.columns else raw)
    whole = F.col("dist").isNotNull() & F.col("paths12").isNotNull() & F.col("paths21").isNotNull() & (F.col("host_1") != F.col("host_2"))
    rows = oriented(rows.drop("norm_min_dist", "_const"))
    # One order by pair, which the chunks of windows use again.
    twice = F.lag(key).over(Window.partitionBy("host_1", "host_2").orderBy(key)).eqNullSafe(F.col(key))
    told = F.concat(F.lit("tree "), F.col(key).cast("string"), F.lit(": the pair "), F.col("host_1"), F.lit(" and "), F.col("host_2"))
    right = F.when(~F.coalesce(whole, F.lit(False)), F.raise_error(F.concat(told, F.lit(" lacks a distance or paths, or is one host")))).when(twice, F.raise_error(F.concat(told, F.lit(" comes twice")))).otherwise(F.lit(True))
    return rows.withColumn("_right", right).where("_right").drop("_right")


def counts_of_windows(windows: Sequence[DataFrame], spans: DataFrame, constants: DataFrame | None = None, hosts: DataFrame | None = None, min_reads: int = 1, min_tips: int = 1, close: float = 0.025, distant: float = 0.05, w_slide: int | None = None, key: str = "tree_id") -> DataFrame:
    """From the classifications of trees to counts: merged, with each tree's w_start and w_end (spans), of hosts with enough reads and tips (hosts: key, host, reads, tips), categorised and counted."""
    rows = merged(windows, constants, key).join(spans.select(key, "w_start", "w_end"), key)
    rows = rows if hosts is None else with_enough(rows, hosts, min_reads, min_tips)
    return counts(categorised(rows, close, distant), w_slide=w_slide)


def categorised(pairs: DataFrame, close: float = 0.025, distant: float = 0.05) -> DataFrame:
    """cat_dist, basic and CATEGORIES. Close is below `close`; distant is `distant` or above."""
    a, c, anc = F.col("adjacent"), F.col("contiguous"), F.col("ancestry")
    cat_dist = F.when(F.col("dist") < close, "close").when(F.col("dist") >= distant, "distant").otherwise("intermediate")
    kind = F.when(anc.isin("anc", "multiAnc"), "anc").when(anc.isin("desc", "multiDesc"), "desc").when(anc == "complex", "intermingled").otherwise("sibling")
    basic = F.when(~a, "other").otherwise(F.concat(kind, F.when(c, "_contiguous").otherwise("_noncontiguous")))
    near = F.col("cat_dist") == "close"
    is_anc, is_desc = F.col("basic").startswith("anc"), F.col("basic").startswith("desc")

    def ancestry(both: Column, rest: str) -> Column:
        return F.when(~both, rest).when(is_anc, "12").when(is_desc, "21").otherwise("complex.or.no.ancestry")

    def directed(both: Column) -> Column:
        return F.when(both & is_anc, "12").when(both & is_desc, "21")

    return pairs.withColumns({"cat_dist": cat_dist, "basic": basic}).withColumns({
        "proximity_3_way_cat": F.col("cat_dist"),
        "any_ancestry_cat": F.when(c & (is_anc | is_desc | F.col("basic").startswith("intermingled")), "anc.or.complex").otherwise("other"),
        "close_x_contiguous_cat": F.when(c & near, "contiguous_close").when(c, "contiguous_not.close").when(near, "noncontiguous_close").otherwise("not.close.other"),
        "close_and_adjacent_cat": F.when(near & a, "close.and.adjacent").otherwise("not.close.or.nonadjacent"),
        "close_and_contiguous_cat": F.when(near & c, "close.and.contiguous").otherwise("not.close.or.noncontiguous"),
        "close_and_adjacent_and_ancestry_cat": ancestry(near & a, "not.close.or.nonadjacent"),
        "close_and_contiguous_and_ancestry_cat": ancestry(near & c, "not.close.or.noncontiguous"),
        "close_and_adjacent_and_directed_cat": directed(near & a),
        "close_and_contiguous_and_directed_cat": directed(near & c),
    })


def plot_labels(pairs: DataFrame) -> DataFrame:
    """Topology without contiguity, in words, and a distance that a log axis can show."""
    stem = F.regexp_replace("basic", "_[^_]*$", "")
    return pairs.withColumns({"topology": F.when(stem == "anc", "ancestral").when(stem == "desc", "descendant").otherwise(stem), "shown_dist": F.greatest(F.col("dist"), F.lit(1e-3))})


def with_enough(pairs: DataFrame, hosts: DataFrame, min_reads: int = 1, min_tips: int = 1) -> DataFrame:
    """Pairs both of whose hosts have the reads and tips in that tree. hosts: tree_id, host, tips, reads."""
    enough = hosts.where((F.col("reads") >= min_reads) & (F.col("tips") >= min_tips)).select("tree_id", "host")
    return pairs.join(enough.withColumnRenamed("host", "host_1"), ["tree_id", "host_1"], "left_semi").join(enough.withColumnRenamed("host", "host_2"), ["tree_id", "host_2"], "left_semi")


def slide(pairs: DataFrame) -> DataFrame:
    """One row: the least step between a pair's windows; 1 without any."""
    by_pair = Window.partitionBy("host_1", "host_2").orderBy("w_start")
    return pairs.select((F.col("w_start") - F.lag("w_start").over(by_pair)).alias("step")).agg(F.coalesce(F.min("step"), F.lit(1)).cast("long").alias("slide"))


def chunked(pairs: DataFrame, w_slide: int | None = None) -> DataFrame:
    """chunk (runs of windows without a gap), n_windows and effective_n (non-overlapping windows' worth)."""
    step = F.lit(w_slide) if w_slide is not None else F.col("slide")
    rows = pairs if w_slide is not None else pairs.crossJoin(F.broadcast(slide(pairs)))  # one row
    by_start = Window.partitionBy("host_1", "host_2").orderBy("w_start")
    new = F.when(F.lag("w_start").over(by_start) == F.col("w_start") - step, 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("chunk", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    chunk = Window.partitionBy("host_1", "host_2", "chunk")
    width = F.col("w_end") + 1 - F.col("w_start")
    return rows.withColumns({"n_windows": F.count("*").over(chunk), "effective_n": (F.max("w_end").over(chunk) + 1 - F.min("w_start").over(chunk)) / width}).drop("_new", "slide")


def counts(dwin: DataFrame, categories: Sequence[str] = CATEGORIES, w_slide: int | None = None) -> DataFrame:
    """For every pair, categorisation and type seen anywhere: k, k_eff, n, n_eff, score; zeros included.

    k_eff weighs a chunk's windows by its effective number of windows. Categories follow from (basic, cat_dist),
    so the counts are made once at that grain and spread over the categorisations afterwards.
    """
    grain = ["basic", "cat_dist", *categories]
    first = F.min_by(F.struct("n_windows", "effective_n"), "w_start")
    by_chunk = chunked(dwin, w_slide).groupBy("host_1", "host_2", "chunk", *grain).agg(F.count("*").alias("k"), first.alias("f"))
    base = by_chunk.groupBy("host_1", "host_2", *grain).agg(F.sum("k").alias("k"), F.sum(F.col("k") / F.col("f.n_windows") * F.col("f.effective_n")).alias("k_eff"))
    each = F.array(F.struct(F.lit("basic").alias("categorisation"), F.col("cat_dist").alias("dist_level"), F.col("basic").alias("type")), *[F.struct(F.lit(c).alias("categorisation"), F.lit(None).cast("string").alias("dist_level"), F.col(c).alias("type")) for c in categories])
    long = base.select("host_1", "host_2", "k", "k_eff", F.explode(each).alias("e")).select("host_1", "host_2", "k", "k_eff", "e.*").where("type is not null")
    key = ["categorisation", "dist_level", "type"]
    long = long.groupBy("host_1", "host_2", *key).agg(F.sum("k").alias("k"), F.sum("k_eff").alias("k_eff"))
    # All types of all categorisations for each pair: a fixed vocabulary of some dozens, whatever the data's size.
    grid = long.select("host_1", "host_2").distinct().crossJoin(F.broadcast(long.select(*key).distinct()))
    right = long.select(*[F.col(c).alias(f"_{c}") for c in ("host_1", "host_2", *key)], "k", "k_eff")
    same = (F.col("host_1") == F.col("_host_1")) & (F.col("host_2") == F.col("_host_2")) & (F.col("categorisation") == F.col("_categorisation")) & F.col("dist_level").eqNullSafe(F.col("_dist_level")) & (F.col("type") == F.col("_type"))
    full = grid.join(right, same, "left").select("host_1", "host_2", *key, F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("k_eff", F.lit(0.0)).alias("k_eff"))
    whole = Window.partitionBy("host_1", "host_2", "categorisation")
    full = full.withColumns({"n": F.sum("k").over(whole), "n_eff": F.sum("k_eff").over(whole)})
    return full.withColumn("score", F.try_divide(F.col("k_eff"), F.col("n_eff")))


def summary(pairs: DataFrame, min_threshold: float = 0, dist_threshold: float = float("inf"), close_sib_only: bool = False, contiguous: bool = False) -> DataFrame:
    """Windows by ancestry of the pairs that are adjacent (or contiguous) and close: ancestry_tree_count, both_exist, fraction, any_relationship_tree_count."""
    pair = Window.partitionBy("host_1", "host_2")
    rows = pairs.withColumn("both_exist", F.count("*").over(pair))
    close = F.col("dist") < dist_threshold
    rows = rows.where(F.col("contiguous" if contiguous else "adjacent") & (close | (F.col("ancestry") != "noAncestry") if close_sib_only else close))
    rows = rows.groupBy("host_1", "host_2", "ancestry", "both_exist").agg(F.count("*").alias("ancestry_tree_count"))
    rows = rows.withColumn("any_relationship_tree_count", F.sum("ancestry_tree_count").over(pair)).where(F.col("any_relationship_tree_count") > min_threshold)
    back = F.col("ancestry").isin("desc", "multiDesc")
    named = F.when(F.col("ancestry").isin("anc", "desc"), "trans").when(F.col("ancestry").isin("multiAnc", "multiDesc"), "multiTrans").otherwise(F.col("ancestry"))
    fraction = F.concat_ws("/", F.col("ancestry_tree_count").cast("string"), F.col("both_exist").cast("string"))
    return rows.select(F.when(back, F.col("host_2")).otherwise(F.col("host_1")).alias("host_1"), F.when(back, F.col("host_1")).otherwise(F.col("host_2")).alias("host_2"), named.alias("ancestry"), "ancestry_tree_count", "both_exist", fraction.alias("fraction"), "any_relationship_tree_count").distinct()


def _arrow(rows: DataFrame, arrow_threshold: float, total: float) -> DataFrame:
    shown = (F.col("total_12") >= arrow_threshold * total) | (F.col("total_21") >= arrow_threshold * total)
    text = lambda x: F.regexp_replace(F.regexp_replace(F.bround(F.round(x / total, 9), 2).cast("decimal(20,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    largest = F.greatest("total_12", "total_21")
    back = shown & (F.col("total_12") <= F.col("total_21"))
    return rows.select(
        F.when(back, F.col("host_2")).otherwise(F.col("host_1")).alias("host_1"), F.when(back, F.col("host_1")).otherwise(F.col("host_2")).alias("host_2"),
        shown.alias("arrow"), F.when(shown, F.concat(text(largest), F.lit("/"), text(F.col("total")))).otherwise(text(F.col("total"))).alias("label"),
    )


def simplified(summary_rows: DataFrame, arrow_threshold: float, total_trees: int, count_no_ancestry: bool = False) -> DataFrame:
    """One row for each pair: an arrow if one direction has the share of all trees; ties point backwards."""
    swap = F.col("host_2") < F.col("host_1")
    rows = summary_rows.select(F.least("host_1", "host_2").alias("host_1"), F.greatest("host_1", "host_2").alias("host_2"), swap.alias("back"), "ancestry", F.col("ancestry_tree_count").alias("n"))
    one_way = F.col("ancestry").isin("trans", "multiTrans")
    even = F.col("ancestry").isin("complex", *(["noAncestry"] if count_no_ancestry else []))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    wide = rows.groupBy("host_1", "host_2").agg(total(one_way & ~F.col("back")).alias("total_12"), total(one_way & F.col("back")).alias("total_21"), total(even).alias("total_equiv"))
    return _arrow(wide.withColumn("total", F.col("total_12") + F.col("total_21") + F.col("total_equiv")), arrow_threshold, float(total_trees))


def simplified_multinomial(dc: DataFrame, win_threshold: float, arrow_threshold: float, contiguous: bool = False) -> DataFrame:
    """The same from scores: pairs whose scores of any relationship come to win_threshold."""
    cat = f"close_and_{'contiguous' if contiguous else 'adjacent'}_and_ancestry_cat"
    rows = dc.where((F.col("categorisation") == cat) & ~F.col("type").startswith("not.close"))
    wide = rows.groupBy("host_1", "host_2").pivot("type", ["12", "21", "complex.or.no.ancestry"]).agg(F.sum("score"))
    wide = wide.select("host_1", "host_2", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(n) for c, n in (("12", "total_12"), ("21", "total_21"), ("complex.or.no.ancestry", "total_equiv"))])
    wide = wide.withColumn("total", F.col("total_12") + F.col("total_21") + F.col("total_equiv")).where((F.col("total") >= win_threshold) & (F.col("total") > 0))
    return _arrow(wide, arrow_threshold, 1.0)

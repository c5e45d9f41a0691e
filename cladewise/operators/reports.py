"""Tables around the analysis: batches of individuals, the grid of pairs and trees, reports in order, checks of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str, name: str = "number") -> DataFrame:
    """rows with their numbers from 1 in ascending order of a column of distinct values. Ranges are sorted apart; only their sizes meet in one task."""
    ranged = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(before, "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop("_part", "_before")


def batched(individuals: DataFrame, size: int = 50, name: str = "ind") -> DataFrame:
    """run, individual, batch, batch_2: a run for each two batches of `size` individuals, in order of the batches; it has the individuals of both."""
    own = numbered(individuals.select(name).distinct(), name, "_i").select(name, (F.floor((F.col("_i") - 1) / size) + 1).cast("long").alias("b"))
    n = own.agg(F.coalesce(F.max("b"), F.lit(0)).alias("n"))
    batches = n.select("n", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("n", F.lit(1).cast("long")))).alias("batch"))
    pairs = batches.where("batch < n").select("n", "batch", F.explode(F.sequence(F.col("batch") + 1, F.col("n"))).alias("batch_2"))
    # Runs before those of a batch, then the place among its own.
    run = ((F.col("batch") - 1) * (2 * F.col("n") - F.col("batch")) / 2 + F.col("batch_2") - F.col("batch")).cast("long")
    pairs = pairs.select(run.alias("run"), "batch", "batch_2", F.explode(F.array("batch", "batch_2")).alias("b"))
    return pairs.join(own, "b").select("run", name, "batch", "batch_2")


def pair_grid(pairs: DataFrame, hosts: Sequence[str], by_tree: DataFrame, dist_threshold: float, contiguous: bool = False) -> DataFrame:
    """Every two of the chosen hosts in every tree that has pairs, host_1 < host_2: tree_id, host_1, host_2, not_present, host_1_present, host_2_present, within_distance, any_link (in any tree), nondir_ancestry, linked.

    by_tree (tree_id, host) has the hosts of the trees; a pair that is there has both its hosts.
    """
    chosen = sorted(set(hosts))
    both = F.array(*[F.struct(F.lit(a).alias("host_1"), F.lit(b).alias("host_2")) for i, a in enumerate(chosen) for b in chosen[i + 1 :]])
    grid = pairs.select("tree_id").distinct().select("tree_id", F.explode(both).alias("p")).select("tree_id", "p.host_1", "p.host_2")
    rows = grid.join(pairs.select("tree_id", "host_1", "host_2", "ancestry", "adjacent", "contiguous", "dist"), ["tree_id", "host_1", "host_2"], "left").withColumn("not_present", F.col("ancestry").isNull())
    for k in (1, 2):
        there = by_tree.select("tree_id", F.col("host").alias(f"host_{k}"), F.lit(True).alias(f"there_{k}")).distinct()
        rows = rows.join(there, ["tree_id", f"host_{k}"], "left").withColumn(f"host_{k}_present", ~F.col("not_present") | F.col(f"there_{k}").isNotNull())
    rows = rows.withColumn("within_distance", F.col("dist") <= dist_threshold)
    link = F.bool_or(F.coalesce(~F.col("not_present") & F.col("adjacent") & F.col("within_distance"), F.lit(False)))
    rows = rows.withColumn("any_link", link.over(Window.partitionBy("host_1", "host_2")))
    named = F.when(F.col("ancestry").isin("anc", "desc"), "trans").when(F.col("ancestry").isin("multiAnc", "multiDesc"), "multiTrans").otherwise(F.col("ancestry"))
    near = F.col("contiguous") if contiguous else F.col("adjacent")
    return rows.select("tree_id", "host_1", "host_2", "not_present", "host_1_present", "host_2_present", "within_distance", "any_link", named.alias("nondir_ancestry"), (near & F.col("within_distance")).alias("linked"))


def recombination_report(found: DataFrame, samples: DataFrame, key: str = "window_id") -> DataFrame:
    """Lines of each window's report in order: window, line, sample, metric. The highest metric comes first, ties by sample; samples without reads there follow, with no metric. samples: window, sample."""
    rows = samples.select(key, "sample").distinct().join(found.select(key, "sample", "metric"), [key, "sample"], "left")
    order = Window.partitionBy(key).orderBy(F.col("metric").desc_nulls_last(), "sample")
    return rows.select(key, F.row_number().over(order).cast("long").alias("line"), "sample", "metric")


def have_read_counts(tips: DataFrame, pattern: str, key: str = "tree_id") -> DataFrame:
    """Of each tree whether any tip's label has a read count, the last group of the pattern."""
    count = F.regexp_extract("label", pattern, 1)
    return tips.groupBy(key).agg(F.bool_or(F.col("label").rlike(pattern) & (count != "")).alias("counted"))


def same_names(one: DataFrame, two: DataFrame, name: str = "name") -> DataFrame:
    """One row: whether two tables have the same names, and how many only one of them has."""
    left, right = one.select(name).distinct().withColumn("_a", F.lit(1)), two.select(name).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, name, "full").agg(F.count_if(F.col("_b").isNull()).alias("only_one"), F.count_if(F.col("_a").isNull()).alias("only_two"))
    return both.select(((F.col("only_one") == 0) & (F.col("only_two") == 0)).alias("same"), "only_one", "only_two")


def with_proportions(statistics: DataFrame, splits: DataFrame) -> DataFrame:
    """Statistics of hosts in trees with the shares of their reads in their subgraphs, largest first: an array, as their number has no bound. splits: tree_id, host, subgraph, reads."""
    by = splits.groupBy("tree_id", "host", "subgraph").agg(F.sum("reads").alias("reads"))
    whole = by.groupBy("tree_id", "host").agg(F.sum("reads").alias("total"), F.sort_array(F.collect_list("reads"), asc=False).alias("reads"))
    shares = whole.select("tree_id", "host", F.transform("reads", lambda r: r / F.col("total")).alias("proportions"))
    return statistics.join(shares, ["tree_id", "host"])

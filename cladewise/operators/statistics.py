"""Statistics of hosts in trees, and tests of descent and reachability, over the closure of a tree (trees.closure).

tips: tree_id, host, node, reads, subgraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees as T


def host_descent(up: DataFrame, tips: DataFrame, key: str = "tree_id") -> DataFrame:
    """Pairs of hosts of each tree: key, host_1, host_2, descends_12 (host_2 from host_1), descends_21, intermingled.

    A host descends from another if its MRCA is below the other's and above none of the other's tips. Two are
    intermingled if their MRCAs are one, or one's is below the other's and above one of the other's tips.
    """
    top = T.mrca(up, tips.select(key, "host", "node"), "host", key).select(key, "host", "mrca")
    above = up.where("hops > 0").select(key, "node", "ancestor")
    reach = tips.select(key, "host", "node").join(above, [key, "node"]).select(key, "host", "ancestor").distinct()
    pairs = top.toDF(key, "host_1", "mrca_1").join(top.toDF(key, "host_2", "mrca_2"), key).where("host_1 < host_2")
    for a, b in ((1, 2), (2, 1)):
        pairs = pairs.join(above.toDF(key, f"mrca_{b}", f"mrca_{a}").withColumn(f"over_{a}", F.lit(True)), [key, f"mrca_{a}", f"mrca_{b}"], "left")
        pairs = pairs.join(reach.toDF(key, f"host_{a}", f"mrca_{b}").withColumn(f"reach_{a}", F.lit(True)), [key, f"host_{a}", f"mrca_{b}"], "left")
    pairs = pairs.na.fill(False, ["over_1", "over_2", "reach_1", "reach_2"])
    return pairs.selectExpr(key, "host_1", "host_2", "over_1 and not reach_1 as descends_12", "over_2 and not reach_2 as descends_21", "mrca_1 = mrca_2 or over_1 and reach_1 or over_2 and reach_2 as intermingled")


def path_exists(up: DataFrame, asked: DataFrame, key: str = "tree_id") -> DataFrame:
    """asked (key, node_1, node_2, node_3) with open: whether the path from the first node to the second avoids the third, unless that is its end."""
    own = up.select(key, "node", "ancestor", "hops")
    asked = asked.select(key, "node_1", "node_2", "node_3").distinct()
    both = asked.join(own.toDF(key, "node_1", "ancestor", "h1"), [key, "node_1"]).join(own.toDF(key, "node_2", "ancestor", "h2"), [key, "node_2", "ancestor"])
    met = both.groupBy(key, "node_1", "node_2", "node_3").agg(F.min_by("ancestor", "h1").alias("mrca"), F.bool_or(F.col("ancestor") == F.col("node_3")).alias("over_both"))
    for k in (1, 2):
        met = met.join(own.select(key, F.col("node").alias(f"node_{k}"), F.col("ancestor").alias("node_3"), F.lit(True).alias(f"over_{k}")), [key, f"node_{k}", "node_3"], "left")
    on = F.coalesce(F.col("over_1"), F.lit(False)) != F.coalesce(F.col("over_2"), F.lit(False))
    shut = (on | (F.col("node_3") == F.col("mrca"))) & (F.col("node_3") != F.col("node_2"))
    return met.select(key, "node_1", "node_2", "node_3", ((F.col("node_1") == F.col("node_2")) | ~shut).alias("open"))


def reachable_tips(up: DataFrame, nodes: DataFrame, blocked: DataFrame, starts: DataFrame, key: str = "tree_id") -> DataFrame:
    """Tips that a start (key, start) reaches without a blocked branch (key, node: the one above the node): key, start, tip."""
    tops = nodes.where("parent is null").select(key, F.col("node").alias("ancestor")).unionByName(blocked.select(key, F.col("node").alias("ancestor"))).distinct()
    part = up.join(tops, [key, "ancestor"]).groupBy(key, "node").agg(F.min_by("ancestor", "hops").alias("part"))
    tips = nodes.where("is_tip").select(key, "node").join(part, [key, "node"]).select(key, "part", F.col("node").alias("tip"))
    return starts.select(key, F.col("start").alias("node")).distinct().join(part, [key, "node"]).join(tips, [key, "part"]).select(key, F.col("node").alias("start"), "tip")


def longest_branch(up: DataFrame, nodes: DataFrame, tips: DataFrame, key: str = "tree_id") -> DataFrame:
    """The longest branch of the tree of a host's tips alone, unrooted (a root of two branches makes them one): key, host, max_branch. Hosts of one tip have none."""
    on = tips.select(key, "host", "node").join(up.select(key, "node", "ancestor"), [key, "node"]).select(key, "host", F.col("ancestor").alias("node")).distinct()
    forks = on.join(nodes.where("parent is not null").select(key, "node", "parent"), [key, "node"]).groupBy(key, "host", "parent").agg(F.count("*").alias("c")).where("c > 1").select(key, "host", F.col("parent").alias("ancestor"))
    kept = tips.select(key, "host", "node").unionByName(forks.withColumnRenamed("ancestor", "node"))
    over = kept.join(up.where("hops > 0").select(key, "node", "ancestor", "hops", "dist"), [key, "node"]).join(forks, [key, "host", "ancestor"])
    branch = over.groupBy(key, "host", "node").agg(F.min(F.struct("hops", "ancestor", "dist")).alias("b")).select(key, "host", "node", F.col("b.ancestor").alias("ancestor"), F.col("b.dist").alias("dist"))
    by = branch.groupBy(key, "host", "ancestor").agg(F.count("*").alias("c"), F.max("dist").alias("far"), F.sum("dist").alias("sum"))
    inner = branch.select(key, "host", F.col("node").alias("ancestor"), F.lit(True).alias("inner"))
    by = by.join(inner, [key, "host", "ancestor"], "left")
    return by.groupBy(key, "host").agg(F.max(F.when(F.col("inner").isNull() & (F.col("c") == 2), F.col("sum")).otherwise(F.col("far"))).alias("max_branch"))


STATISTICS = ("overall_rtt", "largest_rtt", "max_branch", "max_dist", "mean_dist", "largest_mean_dist")


def subtree_statistics(up: DataFrame, nodes: DataFrame, tips: DataFrame, key: str = "tree_id") -> DataFrame:
    """STATISTICS by key and host: root to tip over all tips and over those of the largest subgraph (by reads, then the first by name), the longest branch, and distances between tips, of all and of the largest subgraph.

    Of one tip, root to tip is 0 and the others are null; if only the largest subgraph has one, its mean alone is null.
    """
    by = tips.groupBy(key, "host", "subgraph").agg(F.sum("reads").alias("r"))
    winner = by.groupBy(key, "host").agg(F.min_by("subgraph", F.struct(-F.col("r"), F.col("subgraph"))).alias("subgraph"))
    largest = tips.join(winner, [key, "host", "subgraph"])

    def of(rows: DataFrame, rtt: str, *distances) -> DataFrame:
        far = T.root_to_tip(nodes, rows, key).select(key, "host", F.col("rtt").alias(rtt))
        return far.join(T.tip_distances(nodes, rows, key).groupBy(key, "host").agg(*distances), [key, "host"], "left")

    out = of(tips, "overall_rtt", F.max("dist").alias("max_dist"), F.avg("dist").alias("mean_dist"))
    out = out.join(of(largest, "largest_rtt", F.avg("dist").alias("largest_mean_dist")), [key, "host"]).join(longest_branch(up, nodes, tips, key), [key, "host"], "left")
    return out.select(key, "host", *STATISTICS)


def window_statistics(up: DataFrame, nodes: DataFrame, tips: DataFrame, hosts: DataFrame, constants: DataFrame, recombination: DataFrame | None = None, duals: DataFrame | None = None, key: str = "tree_id") -> DataFrame:
    """Each host in each tree: tips, reads, subgraphs, clades, STATISTICS, and these over the tree's norm_const (1 if it has none).

    A host that a tree lacks has counts of 0 and null statistics. recombination (key, host, recombination_metric)
    keeps the hosts that it has; duals (key, host, dual_count) may lack some.
    """
    all_rows = nodes.select(key).distinct().crossJoin(hosts.select("host").distinct())
    counts = tips.groupBy(key, "host").agg(F.count("*").alias("tips"), F.sum("reads").alias("reads"), F.countDistinct("subgraph").alias("subgraphs"))
    clades = T.host_clades(nodes, key).groupBy(key, "host").agg(F.count("*").alias("clades"))
    rows = all_rows.join(counts, [key, "host"], "left").join(clades, [key, "host"], "left").na.fill(0, ["tips", "reads", "subgraphs", "clades"])
    rows = rows.join(subtree_statistics(up, nodes, tips, key), [key, "host"], "left").join(constants.select(key, "norm_const"), key, "left")
    rows = rows.withColumns({f"normalised_{c}": F.col(c) / F.coalesce("norm_const", F.lit(1.0)) for c in STATISTICS}).drop("norm_const")
    if recombination is not None:
        rows = rows.join(recombination.select(key, "host", "recombination_metric"), [key, "host"])
    return rows.join(duals.select(key, "host", "dual_count"), [key, "host"], "left") if duals is not None else rows

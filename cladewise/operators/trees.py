"""Trees as tables of nodes: closures in SQL where a join expresses it, kernels mapped over trees where order matters.

nodes: tree_id, node, parent (null at the root), edge_length, is_tip, host (null: none), reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.folders import shared_folder
from . import kernels as K


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def closure(nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    """Every node with each of its ancestors, itself included: key, node, ancestor, hops, dist (branch length between).

    Paths double in length with each step until a step adds none, so a tree of depth d takes log2(d) + 1 joins by
    (tree, node); each step's sides are hash-partitioned by tree, its paths are checkpointed, and no tree is
    collected. A node that is its own ancestor is an error of the input.
    """
    paths = _cut(nodes.where("parent is not null").select(key, "node", F.col("parent").alias("ancestor"), F.lit(1).alias("hops"), F.col("edge_length").alias("dist")))
    reach = 1
    while True:
        longest = paths.where(F.col("hops") == reach)
        after = paths.select(key, F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("hops").alias("_h"), F.col("dist").alias("_d"))
        more = longest.join(after, [key, "ancestor"]).select(key, "node", F.col("_next").alias("ancestor"), (F.col("hops") + F.col("_h")).alias("hops"), (F.col("dist") + F.col("_d")).alias("dist"))
        more = _cut(more)
        if more.isEmpty():
            break
        if not more.where("node = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        paths = paths.unionByName(more)
        reach *= 2
    own = nodes.select(key, "node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"), F.lit(0.0).alias("dist"))
    return own.unionByName(paths)


def _by_tree(nodes: DataFrame, key: str, run: Callable[[K.Tree, dict[str, list]], dict[str, list]], schema: StructType, *more: str) -> DataFrame:
    """run(tree, columns by name) for each tree, whose rows are in order of their nodes; it gives columns without the key, which is added. Nothing grows with a tree's depth."""
    kind = nodes.schema[key]

    def one(group: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        rows = {c: part.column(c).to_pylist() for c in part.column_names}
        found = run(K.Tree(rows["node"], rows["parent"], rows["edge_length"], [None] * part.num_rows), rows)
        n = len(next(iter(found.values())))
        made = [pa.array([group[0].as_py()] * n, to_arrow_type(kind.dataType)), *(pa.array(found[f.name], to_arrow_type(f.dataType)) for f in schema.fields)]
        return pa.table(made, names=[key, *schema.names])

    return nodes.select(key, "node", "parent", "edge_length", *more).groupBy(key).applyInArrow(one, StructType([kind, *schema.fields]))


def depths(nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    """Each node's distance from the root (depth) and number of branches to it (level)."""
    run = lambda t, rows: {"node": rows["node"], "depth": t.depth, "level": K.Ancestry(t).level.tolist()}
    return _by_tree(nodes, key, run, StructType().add("node", "long").add("depth", "double").add("level", "long"))


def to_mrca(nodes: DataFrame, members: DataFrame, group: str, key: str = "tree_id") -> DataFrame:
    """Members (key, group, node; a node in one group) with their group's most recent common ancestor: key, group, node, mrca, dist (the branch length up to it)."""
    rows = nodes.drop(group).join(members.select(key, "node", group), [key, "node"], "left")

    def run(t: K.Tree, rows: dict[str, list]) -> dict[str, list]:
        index, of = K.Ancestry(t), {}
        for i, g in enumerate(rows[group]):
            if g is not None:
                of.setdefault(g, []).append(i)
        ends = [(min(own, key=index.place.__getitem__), max(own, key=index.place.__getitem__)) for own in of.values()]
        tops = index.common(*(np.array(x, np.int64) for x in zip(*ends, strict=True))).tolist() if ends else []
        flat = [(g, i, top) for (g, own), top in zip(of.items(), tops, strict=True) for i in own]
        return {group: [g for g, _, _ in flat], "node": [t.id[i] for _, i, _ in flat], "mrca": [t.id[m] for _, _, m in flat], "dist": [t.depth[i] - t.depth[m] for _, i, m in flat]}

    return _by_tree(rows, key, run, StructType([members.schema[group]]).add("node", "long").add("mrca", "long").add("dist", "double"), group)


def mrca(up: DataFrame, members: DataFrame, group: str, key: str = "tree_id") -> DataFrame:
    """Most recent common ancestor of each group of nodes (key, group, node): key, group, mrca, n."""
    size = members.groupBy(key, group).agg(F.count("*").alias("n"))
    shared = members.join(up, [key, "node"]).groupBy(key, group, "ancestor").agg(F.count("*").alias("have"), F.sum("hops").alias("far"))
    shared = shared.join(size, [key, group]).where("have = n")
    return shared.groupBy(key, group).agg(F.min_by("ancestor", F.struct("far", "ancestor")).alias("mrca"), F.first("n").alias("n"))


#: Pairs of tips that leave a task together.
PAIRS = 200_000


def tip_distances(nodes: DataFrame, tips: DataFrame | None = None, key: str = "tree_id", within: str = "host") -> DataFrame:
    """Branch length between each two tips of one host in a tree: key, within, node, other, dist. tips (key, within, node) are the tree's own where none are given.

    A task holds one tree with tables of n log n numbers for its common ancestors; its rows are the pairs asked for,
    and leave in batches, whatever the tree's depth.
    """
    tips = nodes.where("is_tip") if tips is None else tips
    rows = nodes.select(key, "node", "parent", "edge_length").join(tips.select(key, "node", within), [key, "node"], "left")
    kinds = [rows.schema[c] for c in (key, within)]

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches)).sort_by("node")
        node = part.column("node").to_pylist()
        t = K.Tree(node, part.column("parent").to_pylist(), part.column("edge_length").to_pylist(), [None] * len(node))
        index, depth, ids = K.Ancestry(t), np.array(t.depth), np.array(node)
        of: dict[str, list[int]] = {}
        for i, h in enumerate(part.column(within).to_pylist()):
            if h is not None:
                of.setdefault(h, []).append(i)
        types = [to_arrow_type(k.dataType) for k in kinds]
        for h, own in of.items():
            own_, at = np.array(own), 0
            while at < len(own) - 1:
                # As many tips, each with all after it, as make up a batch.
                stop = min(len(own) - 1, at + max(1, PAIRS // (len(own) - at)))
                a = np.repeat(np.arange(at, stop), len(own) - 1 - np.arange(at, stop))
                b = np.concatenate([np.arange(i + 1, len(own)) for i in range(at, stop)])
                x, y = own_[a], own_[b]
                dist = depth[x] + depth[y] - 2 * depth[index.common(x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()] * len(a), types[0]), pa.array([h] * len(a), types[1]), pa.array(ids[x]), pa.array(ids[y]), pa.array(dist)], names=[key, within, "node", "other", "dist"])
                at = stop

    schema = StructType(kinds).add("node", "long").add("other", "long").add("dist", "double")
    return rows.groupBy(key).applyInArrow(run, schema)


def median_tip_distance(distances: DataFrame, key: str = "tree_id") -> DataFrame:
    return distances.groupBy(key).agg(F.median("dist").alias("median_dist"))


def host_clades(nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    """Maximal nodes all of whose tips are one host's: key, node, host, tips."""

    def run(t: K.Tree, rows: dict[str, list]) -> dict[str, list]:
        # Of each node: its tips' only host (None: several, or a tip without), and how many there are. Inner nodes without tips count for nothing.
        host, tips = [None] * len(t.id), [0] * len(t.id)
        for i in t.up:
            below = [c for c in t.children[i] if tips[c]]
            if rows["is_tip"][i]:
                host[i], tips[i] = rows["host"][i], 1
            elif below:
                hosts = {host[c] for c in below}
                host[i], tips[i] = hosts.pop() if len(hosts) == 1 else None, sum(tips[c] for c in below)
        top = [i for i in t.down if host[i] is not None and (t.parent[i] < 0 or host[t.parent[i]] is None)]
        return {"node": [t.id[i] for i in top], "host": [host[i] for i in top], "tips": [tips[i] for i in top]}

    return _by_tree(nodes, key, run, StructType().add("node", "long").add("host", "string").add("tips", "long"), "is_tip", "host")


def root_to_tip(nodes: DataFrame, tips: DataFrame | None = None, key: str = "tree_id") -> DataFrame:
    """Read-weighted mean distance from a host's MRCA to its tips (key, host, node, reads; the tree's own where none are given); 0 for one tip: key, host, rtt, tips, reads."""
    tips = (nodes.where("is_tip") if tips is None else tips).where("host is not null").select(key, "host", "node", "reads")
    far = to_mrca(nodes.drop("reads"), tips, "host", key).join(tips.select(key, "node", "reads"), [key, "node"])
    return far.groupBy(key, "host").agg((F.sum(F.col("dist") * F.col("reads")) / F.sum("reads")).alias("rtt"), F.count("*").alias("tips"), F.sum("reads").alias("reads"))


def threshold_guess(nodes: DataFrame, width: int, key: str = "tree_id") -> DataFrame:
    """Below which inner branches are no branches: -1 (none) if the shortest exceeds a quarter of a base per window; 1e-9 if it is 0; else a little over the shortest."""
    least = F.min("edge_length")
    return nodes.where("parent is not null").groupBy(key).agg(F.when(least > 0.25 / width, -1.0).when(least == 0, 1e-9).otherwise(least * 1.0001).alias("threshold"))


def short_branches_collapsed(nodes: DataFrame, threshold: float, key: str = "tree_id") -> DataFrame:
    """Inner nodes on branches below the threshold go; their children hang on the nearest node above that stays. Terminal branches keep their length."""
    inner = nodes.where(~F.col("is_tip") & F.col("parent").isNotNull() & (F.col("edge_length") < threshold)).select(key, F.col("node").alias("gone"))
    up = closure(nodes, key).where("hops > 0")
    stays = up.join(inner.withColumnRenamed("gone", "ancestor"), [key, "ancestor"], "left_anti")
    new = stays.groupBy(key, "node").agg(F.min_by("ancestor", "hops").alias("new_parent"))
    kept = nodes.join(inner.withColumnRenamed("gone", "node"), [key, "node"], "left_anti")
    return kept.join(new, [key, "node"], "left").withColumn("parent", F.col("new_parent")).drop("new_parent")


def normalised(nodes: DataFrame, constants: DataFrame, key: str = "tree_id", back: bool = False) -> DataFrame:
    """Branch lengths over a tree's constant (1 if it has none); back multiplies."""
    c = F.coalesce("norm_const", F.lit(1.0))
    rows = nodes.join(constants.select(key, "norm_const"), key, "left")
    return rows.withColumn("edge_length", F.col("edge_length") * c if back else F.col("edge_length") / c).drop("norm_const")


def subtree_cost(up: DataFrame, nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    """Branch length under a node that leads to a host's tips: key, node, host, cost."""
    reached = nodes.where("is_tip and host is not null").select(key, F.col("node").alias("tip"), "host").join(up.select(key, F.col("node").alias("tip"), F.col("ancestor").alias("branch")), [key, "tip"]).select(key, "host", "branch").distinct()
    on = reached.join(nodes.where("parent is not null").select(key, F.col("node").alias("branch"), "edge_length"), [key, "branch"])
    above = up.where("hops > 0").select(key, F.col("node").alias("branch"), F.col("ancestor").alias("node"))
    inner = on.join(above, [key, "branch"]).groupBy(key, "node", "host").agg(F.sum("edge_length").alias("cost"))
    return inner.unionByName(nodes.where("is_tip and host is not null").select(key, "node", "host", F.lit(0.0).alias("cost")))


# -- kernels by tree ---------------------------------------------------------------------------------------


def _tree(rows: pd.DataFrame) -> K.Tree:
    rows = rows.sort_values("node")
    return K.Tree(rows["node"].tolist(), [None if pd.isna(p) else int(p) for p in rows["parent"]], rows["edge_length"].tolist(), [None if pd.isna(h) else h for h in rows["host"]], rows["reads"].tolist())


def _states(t: K.Tree, method: str, k: float, p: float) -> tuple[list[str], float]:
    if method == "s":
        cost = K.parsimony(t, k)
        return K.trace(t, cost, k, p), float(cost[t.roots[0]].rest)
    if method == "f":
        cost, state = K.continuation(t, k or 1.0, p)
        return state, float(cost[t.roots[0], -1])
    if method == "r":
        return K.majority(t), float("nan")
    raise ValueError(f"unknown method {method!r}")


_COLUMNS = ("node", "parent", "edge_length", "host", "reads")


def reconstructed(nodes: DataFrame, method: str = "s", k: float = 0.0, p: float = 0.0, count_reads: bool = False, key: str = "tree_id") -> DataFrame:
    """Each node's state and subgraph: key, node, state, split, first, root_cost. A group is one tree."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = _tree(rows if count_reads else rows.assign(reads=1))
        state, cost = _states(t, method, k, p)
        name, first = K.splits(t, state)
        return pd.DataFrame({key: group[0], "node": t.id, "state": state, "split": name, "first": first, "root_cost": cost})

    kind = nodes.schema[key].dataType.simpleString()
    return nodes.select(key, *_COLUMNS).groupBy(key).applyInPandas(run, f"{key} {kind}, node long, state string, split string, first boolean, root_cost double")


def collapsed(nodes: DataFrame, method: str = "s", k: float = 0.0, p: float = 0.0, key: str = "tree_id") -> DataFrame:
    """key, split, parent_split, host, parent_host, length, root_node."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = _tree(rows.assign(reads=1))
        state, _ = _states(t, method, k, p)
        out = K.collapsed(t, *K.splits(t, state), state)
        return pd.DataFrame([(group[0], *r) for r in out], columns=[key, "split", "parent_split", "host", "parent_host", "length", "root_node"])

    kind = nodes.schema[key].dataType.simpleString()
    return nodes.select(key, *_COLUMNS).groupBy(key).applyInPandas(run, f"{key} {kind}, split string, parent_split string, host string, parent_host string, length double, root_node long")


_CLASSIFIED = "host_1 string, host_2 string, adjacent boolean, contiguous boolean, paths12 long, paths21 long, nodes1 long, nodes2 long, ancestry string, min_dist double"


def _classified(t: K.Tree, state: list[str], key: str, value: object, options: dict) -> pd.DataFrame:
    name, first = K.splits(t, state)
    out = K.classified(K.collapsed(t, name, first, state), t, name, **options)
    return pd.DataFrame([(value, *r) for r in out], columns=[key, *(c.split()[0] for c in _CLASSIFIED.split(", "))])


def classified(nodes: DataFrame, method: str = "s", k: float = 0.0, p: float = 0.0, key: str = "tree_id", **options) -> DataFrame:
    """Pairs of hosts of each tree with their classification; options as in kernels.ancestry_class."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t = _tree(rows.assign(reads=1))
        return _classified(t, _states(t, method, k, p)[0], key, group[0], options)

    kind = nodes.schema[key].dataType.simpleString()
    return nodes.select(key, *_COLUMNS).groupBy(key).applyInPandas(run, f"{key} {kind}, {_CLASSIFIED}")


def classified_states(nodes: DataFrame, key: str = "tree_id", **options) -> DataFrame:
    """The same of trees whose nodes have a state already (column state: a host or "unassigned")."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        return _classified(_tree(rows.assign(reads=1)), rows["state"].tolist(), key, group[0], options)

    kind = nodes.schema[key].dataType.simpleString()
    return nodes.select(key, *_COLUMNS, "state").groupBy(key).applyInPandas(run, f"{key} {kind}, {_CLASSIFIED}")


# -- collapsed trees in SQL: key, split, parent_split, host -------------------------------------------------


def split_adjacency(splits: DataFrame, key: str = "tree_id") -> DataFrame:
    """Pairs of hosts with neighbouring subgraphs: a branch between them, or one unassigned region beside both."""
    edge = splits.where("parent_split is not null").select(key, F.col("split").alias("a"), F.col("parent_split").alias("b"))
    edge = edge.unionByName(edge.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    host = splits.select(key, F.col("split").alias("a"), F.col("host").alias("host_a"))
    both = edge.join(host, [key, "a"]).join(host.select(key, F.col("a").alias("b"), F.col("host_a").alias("host_b")), [key, "b"])
    direct = both.where("host_a < host_b and host_a <> 'unassigned' and host_b <> 'unassigned'").select(key, F.col("host_a").alias("host_1"), F.col("host_b").alias("host_2"))
    beside = both.where("host_a = 'unassigned' and host_b <> 'unassigned'").select(key, F.col("a").alias("region"), F.col("host_b").alias("host")).distinct()
    around = beside.select(key, "region", F.col("host").alias("host_1")).join(beside.select(key, "region", F.col("host").alias("host_2")), [key, "region"]).where("host_1 < host_2").select(key, "host_1", "host_2")
    return direct.unionByName(around).distinct()


def split_paths(splits: DataFrame, key: str = "tree_id") -> DataFrame:
    """Per ordered pair of hosts, the subgraphs of host_2 that have an ancestor of host_1: key, host_1, host_2, paths, nodes (subgraphs of host_2)."""
    up = closure(splits.select(key, F.col("split").alias("node"), F.col("parent_split").alias("parent"), F.lit(0.0).alias("edge_length")), key).where("hops > 0")
    host = splits.where("host <> 'unassigned'").select(key, F.col("split").alias("node"), F.col("host").alias("host_2"))
    above = splits.where("host <> 'unassigned'").select(key, F.col("split").alias("ancestor"), F.col("host").alias("host_1"))
    nodes = host.groupBy(key, "host_2").agg(F.count("*").alias("nodes"))
    found = up.join(host, [key, "node"]).join(above, [key, "ancestor"]).where("host_1 <> host_2").groupBy(key, "host_1", "host_2").agg(F.countDistinct("node").alias("paths"))
    return found.join(nodes, [key, "host_2"])


def tips_and_reads(tips: DataFrame, key: str = "tree_id") -> DataFrame:
    """Tips and reads of every host in every tree, 0 where a tree lacks it: key, host, tips, reads. The grid is trees x hosts, as asked for."""
    counts = tips.where("host is not null").groupBy(key, "host").agg(F.count("*").alias("tips"), F.sum("reads").alias("reads"))
    grid = tips.select(key).distinct().crossJoin(counts.select("host").distinct())
    return grid.join(counts, [key, "host"], "left").na.fill(0, ["tips", "reads"])


def read_proportions(splits: DataFrame, key: str = "tree_id", host: str = "host") -> DataFrame:
    """A host's reads by subgraph as shares, largest first, filled with 0 up to the most subgraphs of any host and tree."""
    by = splits.groupBy(key, host, "split").agg(F.sum("reads").alias("reads"))
    share = by.withColumn("share", F.col("reads") / F.sum("reads").over(Window.partitionBy(key, host)))
    rows = share.groupBy(key, host).agg(F.reverse(F.array_sort(F.collect_list("share"))).alias("shares"))
    most = rows.agg(F.max(F.size("shares")).alias("_most"))  # one row
    return rows.crossJoin(F.broadcast(most)).select(key, host, F.concat("shares", F.array_repeat(F.lit(0.0), F.col("_most") - F.size("shares"))).alias("shares"))

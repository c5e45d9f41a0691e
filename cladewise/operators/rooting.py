"""Re-rooting on an outgroup and pruning of tips; a group is one tree, and each step one pass over its nodes."""

from __future__ import annotations

from collections.abc import Collection

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = dict[int, tuple[int | None, float]]  # node -> parent (None at the root), length of the branch above


def _children(rows: Rows) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {n: [] for n in rows}
    for n in sorted(rows):
        if rows[n][0] is not None:
            out[rows[n][0]].append(n)
    return out


def contracted(rows: Rows, drop: Collection = ()) -> tuple[Rows, dict[int, int | None]]:
    """The tree without the tips in drop, without inner nodes that then have no tips, and with nodes of one child merged into that child, their branches added up. Also where each node went: itself, the node that it merged into, or None."""
    kids, gone = _children(rows), set(drop)
    order = [n for n, (p, _) in rows.items() if p is None]
    for n in order:  # grows: parents before children
        order.extend(kids[n])
    out: Rows = {}
    stands: dict[int, tuple[int, float]] = {}  # what is left of a node's subtree: its top node, and the branch above that
    went: dict[int, int | None] = {}
    for n in reversed(order):
        length = rows[n][1]
        below = [stands[c] for c in kids[n] if c in stands]
        if not kids[n] and n not in gone or len(below) > 1:
            for top, branch in below:
                out[top] = (n, branch)
            stands[n], went[n] = (n, length), n
        elif below:
            stands[n], went[n] = (below[0][0], below[0][1] + length), below[0][0]
        else:
            went[n] = None
    for n in order:
        if rows[n][0] is None and n in stands:
            out[stands[n][0]] = (None, 0.0)
    return out, went


def turned(rows: Rows, outgroup: int) -> Rows:
    """The root becomes a node of two children: the outgroup with its branch, and the rest with a branch of length 0. Branches on the way to the old root turn round; the new root is numbered after all others. A tree whose root has these two children stays."""
    if outgroup not in rows or rows[outgroup][0] is None:
        return dict(rows)
    beside = rows[outgroup][0]
    if rows[beside][0] is None and len(_children(rows)[beside]) == 2:
        return dict(rows)
    path = [beside]
    while rows[path[-1]][0] is not None:
        path.append(rows[path[-1]][0])
    out, root = dict(rows), max(rows) + 1
    for low, high in zip(path, path[1:]):
        out[high] = (low, rows[low][1])
    out[root], out[beside], out[outgroup] = (None, 0.0), (root, 0.0), (root, rows[outgroup][1])
    return out


def rerooted(rows: Rows, outgroup: int) -> Rows:
    """turned(), without the node of one child that the old root may be then."""
    return contracted(turned(rows, outgroup))[0]


def pruned(rows: Rows, drop: Collection) -> Rows:
    """Without the tips in drop, and without the inner nodes that then split nothing."""
    return contracted(rows, drop)[0]


def processed(nodes: DataFrame, outgroups: DataFrame, drops: DataFrame | None = None, key: str = "tree_id") -> DataFrame:
    """key, node, parent, edge_length, old after rooting on each tree's outgroup (key, outgroup) and dropping tips (key, drop).

    A tree without an outgroup is rooted on its root's first child if that root has over two children, and keeps
    its root otherwise. Each node of the tree before comes as `old`, with the node that it is or has merged into
    (null if nothing is left of it); parent and edge_length stand where old is that node itself. A new root has no old.
    """
    rows = nodes.join(outgroups.select(key, "outgroup"), key, "left")
    rows = rows.withColumn("dropped", F.lit(False)) if drops is None else rows.join(drops.selectExpr(key, "drop AS node", "true AS dropped").distinct(), [key, "node"], "left")

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        before: Rows = {int(r.node): (None if pd.isna(r.parent) else int(r.parent), float(r.edge_length)) for r in part.itertuples()}
        given, kids = part["outgroup"].dropna(), _children(before)
        tops = [c for n, (p, _) in before.items() if p is None for c in kids[n]]
        outgroup = int(given.iloc[0]) if len(given) else tops[0] if len(tops) > 2 else None
        tree, went = contracted(before if outgroup is None else turned(before, outgroup), {int(r.node) for r in part.itertuples() if r.dropped is True and not kids[int(r.node)]})
        out = [(group[0], n, *tree[n], n if n in before else None) for n in sorted(tree)]
        out += [(group[0], went[old], None, None, old) for old in sorted(set(before) - set(tree))]
        return pd.DataFrame(out, columns=[key, "node", "parent", "edge_length", "old"]).astype({"node": "Int64", "parent": "Int64", "old": "Int64"})

    kind = nodes.schema[key].dataType.simpleString()
    return rows.select(key, "node", "parent", "edge_length", "outgroup", "dropped").groupBy(key).applyInPandas(run, f"{key} {kind}, node long, parent long, edge_length double, old long")


def kept(rows: DataFrame) -> DataFrame:
    """Of processed(): the nodes of the tree as it is now."""
    return rows.where("old is null or old = node").drop("old")


def pruned_trees(nodes: DataFrame, gone: DataFrame, key: str = "tree_id") -> DataFrame:
    """nodes of the trees without the tips in gone (key, tip), roots as they are; other columns stay with their nodes."""
    rows = nodes.join(gone.select(key, F.col("tip").alias("node"), F.lit(True).alias("dropped")).distinct(), [key, "node"], "left")

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        before: Rows = {int(r.node): (None if pd.isna(r.parent) else int(r.parent), float(r.edge_length)) for r in part.itertuples()}
        tree, _ = contracted(before, {int(r.node) for r in part.itertuples() if r.dropped is True})
        return pd.DataFrame([(group[0], n, *tree[n]) for n in sorted(tree)], columns=[key, "node", "parent", "edge_length"]).astype({"parent": "Int64"})

    kind = nodes.schema[key].dataType.simpleString()
    out = rows.select(key, "node", "parent", "edge_length", "dropped").groupBy(key).applyInPandas(run, f"{key} {kind}, node long, parent long, edge_length double")
    return out.join(nodes.drop("parent", "edge_length"), [key, "node"])

"""Cleaning of tips: each step adds tips with a reason, and the first reason of a tip stays.

tips: tree_id, tip, host (null: no host's tip), reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from . import kernels as K
from .rooting import pruned_trees
from .trees import _cut

ORDER = ("bl_user_specified", "bl_duplicate", "bl_parsimony_contaminant", "bl_dual_infection_minor_subgraph", "bl_too_few_tips", "bl_too_few_reads", "downsampled")


def user_specified(tips: DataFrame, listed: DataFrame) -> DataFrame:
    return tips.join(listed.select("tree_id", "tip").distinct(), ["tree_id", "tip"], "left_semi").select("tree_id", "tip", F.lit("bl_user_specified").alias("status"))


def unknown_names(tips: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed tips that no tree has."""
    return listed.join(tips.select("tree_id", "tip"), ["tree_id", "tip"], "left_anti").distinct()


def duplicates(tips: DataFrame, sets: DataFrame, raw: float, ratio: float) -> DataFrame:
    """Of two tips of different hosts in one duplicate set (tree_id, set_id, tip), the rarer, or of equal ones the later by tip, goes if it has fewer reads than raw or less than the ratio of the other's."""
    rows = sets.join(tips, ["tree_id", "tip"]).where("host is not null")
    # The commonest tip of another host decides, and of several the first: what any other condemns, it does too.
    by_set = Window.partitionBy("tree_id", "set_id")
    one = F.struct((-F.col("reads")).alias("less"), "tip", "host", "reads")
    rows = rows.withColumn("_top", F.min(one).over(by_set))
    other = F.min(F.when(F.col("host") != F.col("_top.host"), one)).over(by_set)
    rows = rows.withColumn("_against", F.when(F.col("host") != F.col("_top.host"), F.col("_top")).otherwise(other))
    rarer = (F.col("_against.reads") > F.col("reads")) | ((F.col("_against.reads") == F.col("reads")) & (F.col("_against.tip") < F.col("tip")))
    bad = (F.col("reads") / F.col("_against.reads") < ratio) | (F.col("reads") < raw)
    return rows.where(rarer & bad).select("tree_id", "tip", F.lit("bl_duplicate").alias("status")).distinct()


def host_splits(nodes: DataFrame, k: float) -> DataFrame:
    """Tips with their subgraphs, host by host with all other tips unassigned: tree_id, host, subgraph, tip, reads. Labels are the tips. All trees of a batch are gone through together, level by level; a task holds a batch and the tree that goes on in it."""
    kind = nodes.schema["tree_id"]
    schema = StructType([kind]).add("host", "string").add("subgraph", "string").add("tip", "long").add("reads", "long")

    def found(rows: pa.Table) -> pa.RecordBatch:
        tree, host, name, tip, reads = K.host_subgraphs(*(rows.column(c).to_pylist() for c in ("tree_id", "node", "parent", "edge_length", "host", "reads")), k)
        return pa.RecordBatch.from_arrays([pa.array(tree, to_arrow_type(kind.dataType)), pa.array(host, pa.string()), pa.array(name, pa.string()), pa.array(tip, pa.int64()), pa.array(reads, pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the tree that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("tree_id").to_pylist()
            last = len(ids) - 1
            while last and ids[last - 1] == ids[-1]:
                last -= 1
            if last or held and held[-1].column("tree_id")[-1].as_py() != ids[0]:
                if held or last:
                    yield found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    rows = nodes.select("tree_id", "node", "parent", "edge_length", "host", "reads").repartition("tree_id").sortWithinPartitions("tree_id", "node")
    return rows.mapInArrow(run, schema)


def rare_subgraphs(splits: DataFrame, raw: float, ratio: float) -> DataFrame:
    """Tips of subgraphs with few reads, or with a small share of the host's reads in the tree. A host's only subgraph goes if it has few reads. splits: tree_id, host, subgraph, tip, reads."""
    size = splits.groupBy("tree_id", "host", "subgraph").agg(F.sum("reads").alias("_n"))
    host = Window.partitionBy("tree_id", "host")
    size = size.withColumns({"_all": F.sum("_n").over(host), "_k": F.count("*").over(host)})
    go = size.where((F.col("_n") < raw) | (F.col("_k") > 1) & (F.col("_n") / F.col("_all") < ratio))
    return splits.join(go.select("tree_id", "host", "subgraph"), ["tree_id", "host", "subgraph"], "left_semi").select("tree_id", "tip", F.lit("bl_parsimony_contaminant").alias("status"))


def parsimony_contaminants(nodes: DataFrame, raw: float, ratio: float, k: float) -> DataFrame:
    """rare_subgraphs of host_splits."""
    return rare_subgraphs(host_splits(nodes, k), raw, ratio)


def dual_fraction(splits: DataFrame) -> DataFrame:
    """Per host the share of its trees in which it has several subgraphs. splits: tree_id, host, subgraph, tip, reads."""
    by = splits.groupBy("host", "tree_id").agg(F.countDistinct("subgraph").alias("n"))
    return by.groupBy("host").agg(F.count("*").alias("trees"), F.count_if(F.col("n") > 1).alias("duals"), (F.count_if(F.col("n") > 1) / F.count("*")).alias("fraction"))


def duals(splits: DataFrame, threshold: float) -> DataFrame:
    """In trees where a host is dual: all its tips if it is dual in more than the threshold of its trees, else all but those of the subgraph with most reads."""
    size = splits.groupBy("tree_id", "host", "subgraph").agg(F.sum("reads").alias("reads"))
    best = size.groupBy("tree_id", "host").agg(F.max_by("subgraph", F.struct("reads", "subgraph")).alias("best"), F.count("*").alias("n")).where("n > 1")
    rows = splits.join(best, ["tree_id", "host"]).join(dual_fraction(splits).select("host", "fraction"), "host")
    return rows.where((F.col("fraction") > threshold) | (F.col("subgraph") != F.col("best"))).select("tree_id", "tip", F.lit("bl_dual_infection_minor_subgraph").alias("status"))


def too_few(tips: DataFrame, min_tips: int = 1, min_reads: int = 1) -> DataFrame:
    host = Window.partitionBy("tree_id", "host")
    rows = tips.where("host is not null").withColumns({"_t": F.count("*").over(host), "_r": F.sum("reads").over(host)})
    return rows.where((F.col("_t") < min_tips) | (F.col("_r") < min_reads)).select("tree_id", "tip", F.when(F.col("_t") < min_tips, "bl_too_few_tips").otherwise("bl_too_few_reads").alias("status"))


def downsampled(tips: DataFrame, n: int, keep_short: bool = True, seed: int = 1) -> DataFrame:
    """Exactly n reads of each host and tree, drawn without replacement: tree_id, tip, host, drawn (0: the tip goes).

    Tips are gone through in order; each gets its part of what is left to draw by a hypergeometric variate, so a tip
    is one row however many reads it has. Draws follow a hash of seed, tree and host. Hosts short of n keep all,
    or none.
    """
    rows = tips.where("host is not null").select("tree_id", "host", "tip", F.col("reads").cast("long").alias("reads"), F.xxhash64(F.lit(seed), "tree_id", "host").alias("own_seed"))
    kinds = {c: rows.schema[c] for c in ("tree_id", "tip", "host")}

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("tip")
        reads = rows.column("reads").to_numpy()
        if reads.sum() <= n:
            drawn = reads if keep_short or reads.sum() == n else np.zeros_like(reads)
        else:
            rng, drawn, left, rest = np.random.Generator(np.random.PCG64(rows.column("own_seed")[0].as_py() & (1 << 64) - 1)), [], n, int(reads.sum())
            for own in reads.tolist():
                rest -= own
                drawn.append(int(rng.hypergeometric(own, rest, left)) if left and own else 0)
                left -= drawn[-1]
            drawn = np.array(drawn, np.int64)
        return pa.table([*(rows.column(c) for c in kinds), pa.array(drawn)], names=[*kinds, "drawn"])

    return rows.groupBy("tree_id", "host").applyInArrow(run, StructType([*kinds.values()]).add("drawn", "long"))


def cleaned_in_order(
    nodes: DataFrame, listed: DataFrame | None = None, sets: DataFrame | None = None, raw: float = 0, ratio: float = 0, k: float = 0, dual_threshold: float | None = None, min_tips: int = 1, min_reads: int = 1, most_reads: int | None = None, keep_short: bool = True, splits: DataFrame | None = None,
) -> DataFrame:
    """The six steps one after the other: tree_id, tip, kept, status, drawn (reads left of a tip; null without downsampling).

    A step sees the tips that earlier steps left, in trees pruned to them: listed ones go (listed: tree_id, tip),
    then duplicates (sets), rare subgraphs by parsimony (k over 0; or of the given splits), minor subgraphs of duals,
    hosts with few tips, hosts with few reads (a host's tips and reads are counted anew), and last what is not drawn.
    Tips of no host are only ever listed. A list that is there already and later steps add up. Duals are told by
    the subgraphs of the step before, so they need it.
    """
    every = nodes.where("is_tip").select("tree_id", F.col("node").alias("tip"), "host", "reads")
    gone: DataFrame | None = None

    def left(rows: DataFrame) -> DataFrame:
        return rows if gone is None else rows.join(gone.select("tree_id", "tip"), ["tree_id", "tip"], "left_anti")

    def take(found: DataFrame) -> None:
        nonlocal gone
        found = found.select("tree_id", "tip", "status").distinct()
        # Each step reads what all earlier ones took: the list is cut, a row for each tip that goes.
        gone = _cut(found if gone is None else gone.unionByName(found))

    if listed is not None:
        take(user_specified(every, listed))
    if sets is not None:
        take(duplicates(left(every), left(sets), raw, ratio))
    if k > 0 or splits is not None:
        if splits is None:
            splits = _cut(host_splits(nodes if gone is None else pruned_trees(nodes, gone), k))
        take(rare_subgraphs(left(splits), raw, ratio))
    if dual_threshold is not None:
        if splits is None:
            raise ValueError("minor subgraphs of duals need subgraphs: give k or splits")
        take(duals(left(splits), dual_threshold))
    if min_tips > 1:
        take(too_few(left(every), min_tips))
    if min_reads > 1:
        take(too_few(left(every), 1, min_reads))
    drawn = None
    if most_reads is not None:
        drawn = _cut(downsampled(left(every), most_reads, keep_short))
        take(drawn.where("drawn = 0").withColumn("status", F.lit("downsampled")))
    rows = every.select("tree_id", "tip")
    rows = rows.withColumn("status", F.lit("included")) if gone is None else rows.join(gone, ["tree_id", "tip"], "left").withColumn("status", F.coalesce("status", F.lit("included")))
    rows = rows.withColumn("kept", F.col("status") == "included")
    rows = rows.withColumn("drawn", F.lit(None).cast("long")) if drawn is None else rows.join(drawn.select("tree_id", "tip", "drawn"), ["tree_id", "tip"], "left")
    return rows.select("tree_id", "tip", "kept", "status", "drawn")


def report(tips: DataFrame, *steps: DataFrame) -> DataFrame:
    """tree_id, tip, kept, status: the first step in order that names a tip decides."""
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    found = None
    for s in steps:
        s = s.select("tree_id", "tip", "status")
        found = s if found is None else found.unionByName(s)
    rows = tips.select("tree_id", "tip")
    if found is None:
        return rows.withColumns({"kept": F.lit(True), "status": F.lit("included")})
    first = found.groupBy("tree_id", "tip").agg(F.min_by("status", rank).alias("status"))
    return rows.join(first, ["tree_id", "tip"], "left").select("tree_id", "tip", F.col("status").isNull().alias("kept"), F.coalesce("status", F.lit("included")).alias("status"))


def attached(tips: DataFrame, sequences: DataFrame) -> DataFrame:
    """Tips (tree_id, tip) with their aligned sequence (tree_id, tip, seq). A tree's alignment has each of its tips once and no other name; else the run stops."""
    both = tips.select("tree_id", "tip", F.lit(True).alias("_there")).join(sequences.select("tree_id", "tip", "seq"), ["tree_id", "tip"], "full")
    times = F.count("*").over(Window.partitionBy("tree_id", "tip"))
    told = lambda what: F.raise_error(F.concat(F.lit("tree "), F.col("tree_id").cast("string"), F.lit(f": {what} "), F.col("tip").cast("string")))
    right = F.when(F.col("_there").isNull(), told("no tip has the name")).when(F.col("seq").isNull(), told("no sequence has the name")).when(times > 1, told("more than one has the name")).otherwise(F.lit(True))
    return both.withColumn("_right", right).where("_right").select("tree_id", "tip", "seq")


def cleaned(sequences: DataFrame, status: DataFrame) -> DataFrame:
    """Aligned sequences (tree_id, tip, seq) without those of tips that go. Tips and sequences have to have the same names."""
    return attached(status.where("kept or not kept"), sequences).join(status.where("not kept").select("tree_id", "tip"), ["tree_id", "tip"], "left_anti")

"""Linked pairs, networks of hosts and most likely chains.

dc: host_1, host_2, categorisation, dist_level, type, k, k_eff, n, n_eff, score (relations.counts).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.folders import shared_folder
from .kernels import edmonds
from .reports import numbered

LINK = ("close_and_adjacent_cat", "close.and.adjacent", "not.close.or.nonadjacent")
SCORES, AMBIGUOUS = "close_and_adjacent_and_ancestry_cat", "complex.or.no.ancestry"
DIRECTED = "close_and_adjacent_and_directed_cat"


def linked_pairs(dc: DataFrame, neff_cut: float = 3, conf_cut: float = 0.6) -> DataFrame:
    """Pairs that are not surely unlinked and have some evidence for a link, with the link's counts."""
    group, yes, no = LINK
    maybe = dc.where((F.col("categorisation") == group) & (F.col("type") == no) & (F.col("n_eff") >= neff_cut) & (F.col("k_eff") / F.col("n_eff") < conf_cut)).select("host_1", "host_2")
    return dc.where((F.col("categorisation") == group) & (F.col("type") == yes) & (F.col("k_eff") / F.col("n_eff") > 0)).join(maybe, ["host_1", "host_2"], "left_semi")


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows of the given pairs; a pair without rows stays, with nulls."""
    return pairs.select("host_1", "host_2").join(rows, ["host_1", "host_2"], "left")


def with_metadata(rows: DataFrame, meta: DataFrame, key: str = "id") -> DataFrame:
    """Attributes of both hosts, prefixed h1_ and h2_; of several rows of a host the first in order of its columns counts, as a whole."""
    one = meta.groupBy(key).agg(F.min(F.struct(*[c for c in meta.columns if c != key])).alias("first")).select(key, "first.*")
    for k in (1, 2):
        own = one.select(F.col(key).alias(f"host_{k}"), *[F.col(c).alias(f"h{k}_{c}") for c in one.columns if c != key])
        rows = rows.join(own, f"host_{k}", "left")
    return rows


#: Links that one task may hold whole (two names each); beyond, stars are contracted by joins.
ONE_TASK = 200_000


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and the least id that it is linked with, over all links (u, v) of the task."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], names=["id", "label"])


def components(edges: DataFrame, a: str = "host_1", b: str = "host_2", most: int = ONE_TASK) -> DataFrame:
    """Weak components of an edge list: id, label (the least id).

    The links are cut once and counted. Up to `most` are labelled in one task; more by alternating star contraction,
    whose lineage is cut in every round, until a round changes no link.
    """
    shared_folder(edges.sparkSession)
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    if own.count() <= most:
        return own.coalesce(1).mapInArrow(_labelled, StructType().add("id", own.schema["u"].dataType).add("label", own.schema["u"].dataType))
    links = own.where("u <> v")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(links.join(least, "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = small.where("u <> v").distinct().checkpoint()
        # Links only ever point to lesser ids: a round that gives none that is new, and loses none, is the last.
        done = now.join(links, ["u", "v"], "left_anti").isEmpty() and links.join(now, ["u", "v"], "left_anti").isEmpty()
        links = now
        if done:
            break
    label = links.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
    ids = own.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ids.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))


def networks(dc: DataFrame, neff_cut: float = 3) -> DataFrame:
    """Hosts of linked pairs (n_eff over the cut): id, network (numbered by size, then label), size."""
    group, yes, _ = LINK
    pairs = dc.where((F.col("categorisation") == group) & (F.col("type") == yes) & (F.col("n_eff") > neff_cut)).select("host_1", "host_2")
    found = components(pairs)
    size = found.groupBy("label").agg(F.count("*").alias("size")).withColumn("_order", F.struct((-F.col("size")).alias("n"), "label")).checkpoint()
    size = numbered(size, "_order", "network").drop("_order")
    return found.join(size, "label").select("id", "network", "size")


def network_edges(dc: DataFrame, nets: DataFrame, neff_cut: float = 3) -> DataFrame:
    """Linked pairs with their network and the scores of every direction: host_1, host_2, network, size, type, score."""
    group, yes, _ = LINK
    pairs = dc.where((F.col("categorisation") == group) & (F.col("type") == yes) & (F.col("n_eff") > neff_cut)).select("host_1", "host_2")
    pairs = pairs.join(nets.withColumnRenamed("id", "host_1"), "host_1").join(nets.select(F.col("id").alias("host_2"), "network"), ["host_2", "network"])
    return pairs.join(dc.where(F.col("categorisation") == SCORES).select("host_1", "host_2", "type", "score"), ["host_1", "host_2"]).select("host_1", "host_2", "network", "size", "type", "score")


def directions(edges: DataFrame, ambiguous: float = 0.5) -> DataFrame:
    """prob_12 and prob_21 of each pair; an unclear score counts for both with the weight."""
    part = lambda t: F.sum(F.when(F.col("type") == t, F.col("score")).when(F.col("type") == AMBIGUOUS, F.col("score") * ambiguous).otherwise(0.0))
    return edges.where(F.col("type") != LINK[2]).groupBy("network", "size", "host_1", "host_2").agg(part("12").alias("prob_12"), part("21").alias("prob_21"))


def chains(probs: DataFrame) -> DataFrame:
    """Most likely chains: network, host_1, host_2, link_12, link_21.

    Two hosts: the likelier direction, ties to the first. More: the optimum branching of log weights. A group is
    one network; networks are small, as their pairs are linked with confidence.
    """
    first = (F.col("prob_12") >= F.col("prob_21")).cast("int")
    two = probs.where("size = 2").select("network", "host_1", "host_2", first.alias("link_12"), (1 - first).alias("link_21"))

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import math

        weight = {}
        for r in rows.itertuples():
            for u, v, w in ((r.host_1, r.host_2, r.prob_12), (r.host_2, r.host_1, r.prob_21)):
                if w > 0:
                    weight[u, v] = math.log(w)
        low = min(weight.values(), default=0.0)
        found = edmonds({e: w - low + 1 for e, w in weight.items()})
        pairs = [(r.host_1, r.host_2) for r in rows.itertuples()]
        return pd.DataFrame([(group[0], a, b, int((a, b) in found), int((b, a) in found)) for a, b in pairs if (a, b) in found or (b, a) in found], columns=["network", "host_1", "host_2", "link_12", "link_21"])

    more = probs.where("size > 2").select("network", "host_1", "host_2", "prob_12", "prob_21").groupBy("network").applyInPandas(run, "network long, host_1 string, host_2 string, link_12 int, link_21 int")
    return two.unionByName(more)


def decorated(chain: DataFrame, dc: DataFrame) -> DataFrame:
    """Chains with the link's, the directions' and the network's scores; a larger score against the chosen direction becomes 0."""
    group, yes, no = LINK
    linked = dc.where((F.col("categorisation") == group) & (F.col("type") == yes)).select("host_1", "host_2", F.col("score").alias("score_linked"))
    total = lambda t: F.sum(F.when(F.col("type") == t, F.col("score")))
    direction = dc.where(F.col("categorisation") == DIRECTED).groupBy("host_1", "host_2").agg(total("12").alias("score_dir_12"), total("21").alias("score_dir_21"))
    network = dc.where((F.col("categorisation") == SCORES) & (F.col("type") != no)).groupBy("host_1", "host_2").agg(total("12").alias("score_nw_12"), total("21").alias("score_nw_21"), total(AMBIGUOUS).alias("score_nw_amb"))
    rows = chain.where("link_12 = 1 or link_21 = 1").join(linked, ["host_1", "host_2"]).join(direction, ["host_1", "host_2"], "left").join(network, ["host_1", "host_2"])
    filled = ["score_dir_12", "score_dir_21", "score_nw_12", "score_nw_21"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in filled})
    only = lambda yes_, no_: (F.col(f"link_{yes_}") == 1) & (F.col(f"link_{no_}") == 0)
    return rows.withColumns({f"score_{x}_{a}": F.when(only(b, a) & (F.col(f"score_{x}_{a}") > F.col(f"score_{x}_{b}")), 0.0).otherwise(F.col(f"score_{x}_{a}")) for x in ("dir", "nw") for a, b in (("12", "21"), ("21", "12"))})

"""Queries of trees and of cleaning, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blacklist as B
from ..operators import rooting as G
from ..operators import statistics as S
from ..operators import trees as T
from .relation_queries import rounded
from .views import oracle, view

QUERIES, ORACLE = {}, {}


def add(name, sql, run):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = oracle(sql)


def nodes(s, d):
    return view(s, d, "v_nodes")


def up(s, d):
    return T.closure(nodes(s, d))


def host_tips(s, d):
    return nodes(s, d).where("is_tip").select("tree_id", F.col("node").alias("tip"), "host", "reads")


UP = "RECURSIVE nd AS (SELECT * FROM {v_nodes}), up AS (SELECT tree_id, node, node AS ancestor, 0 AS hops, 0e0 AS dist FROM nd UNION ALL SELECT up.tree_id, up.node, nd.parent, up.hops + 1, up.dist + nd.edge_length FROM up JOIN nd ON nd.tree_id = up.tree_id AND nd.node = up.ancestor WHERE nd.parent IS NOT NULL)"
TIPS = "tp AS (SELECT tree_id, node AS tip, host, reads FROM {v_nodes} WHERE is_tip)"

add("tree_closure", f"WITH {UP} SELECT tree_id, node, ancestor, CAST(hops AS BIGINT) AS hops, round(dist, 9) AS dist FROM up", lambda s, d: rounded(up(s, d), "dist").withColumn("hops", F.col("hops").cast("long")))
add("tree_depths", f"WITH {UP} SELECT tree_id, node, round(max(dist), 9) AS depth, CAST(max(hops) AS BIGINT) AS level FROM up GROUP BY tree_id, node", lambda s, d: rounded(T.depths(nodes(s, d)), "depth"))
_MRCA = f"WITH {UP}, sz AS (SELECT tree_id, host, count(*) AS n FROM nd WHERE is_tip GROUP BY tree_id, host), co AS (SELECT nd.tree_id, nd.host, up.ancestor, count(*) AS have, sum(hops) AS far FROM nd JOIN up USING (tree_id, node) WHERE nd.is_tip GROUP BY nd.tree_id, nd.host, up.ancestor), mr AS (SELECT tree_id, host, ancestor AS mrca, n FROM (SELECT co.*, sz.n, row_number() OVER (PARTITION BY co.tree_id, co.host ORDER BY far, ancestor) AS k FROM co JOIN sz ON co.tree_id = sz.tree_id AND co.host = sz.host AND co.have = sz.n) q WHERE k = 1)"
add("host_mrcas", f"{_MRCA} SELECT * FROM mr", lambda s, d: T.to_mrca(nodes(s, d), nodes(s, d).where("is_tip").select("tree_id", "host", "node"), "host").groupBy("tree_id", "host").agg(F.first("mrca").alias("mrca"), F.count("*").alias("n")))
_DIST = f"WITH {UP}, td AS (SELECT a.tree_id, a.host, a.node, b.node AS other, min(ua.dist + ub.dist) AS dist FROM nd a JOIN nd b ON a.tree_id = b.tree_id AND a.host = b.host AND a.node < b.node JOIN up ua ON ua.tree_id = a.tree_id AND ua.node = a.node JOIN up ub ON ub.tree_id = b.tree_id AND ub.node = b.node AND ub.ancestor = ua.ancestor WHERE a.is_tip AND b.is_tip GROUP BY a.tree_id, a.host, a.node, b.node)"
add("tip_distances", f"{_DIST} SELECT tree_id, host, node, other, round(dist, 9) AS dist FROM td", lambda s, d: rounded(T.tip_distances(nodes(s, d)), "dist"))
add("median_tip_distances", f"{_DIST} SELECT tree_id, round(median(dist), 9) AS median_dist FROM td GROUP BY tree_id", lambda s, d: rounded(T.median_tip_distance(T.tip_distances(nodes(s, d))), "median_dist"))
add("host_distance_statistics", f"{_DIST} SELECT tree_id, host, round(max(dist), 9) AS max_dist, round(avg(dist), 9) AS mean_dist, count(*) AS pairs FROM td GROUP BY tree_id, host",
    lambda s, d: rounded(T.tip_distances(nodes(s, d)).groupBy("tree_id", "host").agg(F.max("dist").alias("max_dist"), F.avg("dist").alias("mean_dist"), F.count("*").alias("pairs")), "max_dist", "mean_dist"))
add("host_clades", f"WITH {UP}, un AS (SELECT up.tree_id, up.ancestor AS node, min(nd.host) AS lo, max(nd.host) AS hi, count(*) AS tips FROM nd JOIN up USING (tree_id, node) WHERE nd.is_tip GROUP BY up.tree_id, up.ancestor), mo AS (SELECT * FROM un WHERE lo = hi) SELECT mo.tree_id, mo.node, mo.lo AS host, mo.tips FROM mo JOIN nd ON nd.tree_id = mo.tree_id AND nd.node = mo.node WHERE NOT EXISTS (SELECT 1 FROM mo p WHERE p.tree_id = nd.tree_id AND p.node = nd.parent)",
    lambda s, d: T.host_clades(nodes(s, d)))
add("root_to_tip", f"{_MRCA} SELECT mr.tree_id, mr.host, round(sum(up.dist * nd.reads) / sum(nd.reads), 9) AS rtt, count(*) AS tips, CAST(sum(nd.reads) AS BIGINT) AS reads FROM mr JOIN nd ON nd.tree_id = mr.tree_id AND nd.host = mr.host AND nd.is_tip JOIN up ON up.tree_id = nd.tree_id AND up.node = nd.node AND up.ancestor = mr.mrca GROUP BY mr.tree_id, mr.host",
    lambda s, d: rounded(T.root_to_tip(nodes(s, d)), "rtt"))
add("multifurcation_threshold", "SELECT tree_id, round(CASE WHEN min(edge_length) > 0.25 / 300 THEN -1 WHEN min(edge_length) = 0 THEN 1e-9 ELSE min(edge_length) * 1.0001 END, 9) AS threshold FROM {v_nodes} WHERE parent IS NOT NULL GROUP BY tree_id",
    lambda s, d: rounded(T.threshold_guess(nodes(s, d), 300), "threshold"))
add("short_branches_collapsed", f"WITH {UP}, go AS (SELECT tree_id, node FROM nd WHERE NOT is_tip AND parent IS NOT NULL AND edge_length < 0.0025) SELECT nd.tree_id, nd.node, (SELECT arg_min(up.ancestor, up.hops) FROM up WHERE up.tree_id = nd.tree_id AND up.node = nd.node AND up.hops > 0 AND NOT EXISTS (SELECT 1 FROM go WHERE go.tree_id = up.tree_id AND go.node = up.ancestor)) AS parent, round(edge_length, 9) AS edge_length FROM nd WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.tree_id = nd.tree_id AND go.node = nd.node)",
    lambda s, d: rounded(T.short_branches_collapsed(nodes(s, d), 0.0025), "edge_length").select("tree_id", "node", "parent", "edge_length"))
add("branches_normalised", "SELECT n.tree_id, n.node, round(edge_length / coalesce(norm_const, 1), 9) AS edge_length FROM {v_nodes} n LEFT JOIN {v_norm} c ON c.pos = n.tree_id",
    lambda s, d: rounded(T.normalised(nodes(s, d), view(s, d, "v_norm").withColumnRenamed("pos", "tree_id")), "edge_length").select("tree_id", "node", "edge_length"))
add("subtree_costs", f"WITH {UP}, br AS (SELECT DISTINCT up.tree_id, nd.host, up.ancestor AS branch FROM nd JOIN up USING (tree_id, node) WHERE nd.is_tip) SELECT br.tree_id, up.ancestor AS node, br.host, round(sum(e.edge_length), 9) AS cost FROM br JOIN nd e ON e.tree_id = br.tree_id AND e.node = br.branch AND e.parent IS NOT NULL JOIN up ON up.tree_id = br.tree_id AND up.node = br.branch AND up.hops > 0 GROUP BY br.tree_id, up.ancestor, br.host UNION ALL SELECT tree_id, node, host, 0e0 FROM nd WHERE is_tip",
    lambda s, d: rounded(T.subtree_cost(up(s, d), nodes(s, d)), "cost"))

# The root's least costs, level by level: with k = 0 a change to a host costs 1 and a change to unassigned nothing.
_LEVEL = """, hs AS (SELECT DISTINCT host AS h FROM nd WHERE is_tip UNION ALL SELECT 'unassigned'), c6 AS (SELECT nd.tree_id, node, parent, h, CASE WHEN host = h THEN 0e0 ELSE 1e6 END AS c FROM nd CROSS JOIN hs WHERE is_tip)"""


def _level(k: int) -> str:
    # A tip's or node's cheapest state under the parent's state h: the same one, unassigned, or any other at a cost of 1.
    # Trees need not be complete: an inner node of this level without children is a tip without host.
    low = f"SELECT x.tree_id, x.parent, x.h, least(x.c, u.c, m.c + 1) AS c FROM c{k + 1} x JOIN c{k + 1} u ON u.tree_id = x.tree_id AND u.node = x.node AND u.h = 'unassigned' JOIN (SELECT tree_id, node, min(c) AS c FROM c{k + 1} WHERE h <> 'unassigned' GROUP BY tree_id, node) m ON m.tree_id = x.tree_id AND m.node = x.node"
    up_ = f"SELECT q.tree_id, q.parent AS node, n.parent, q.h, sum(q.c) AS c FROM ({low}) q JOIN nd n ON n.tree_id = q.tree_id AND n.node = q.parent GROUP BY q.tree_id, q.parent, n.parent, q.h"
    bare = f"SELECT n.tree_id, n.node, n.parent, h, CASE WHEN h = 'unassigned' THEN 0e0 ELSE 1e6 END FROM nd n CROSS JOIN hs WHERE n.node BETWEEN {2 ** (k - 1)} AND {2**k - 1} AND NOT EXISTS (SELECT 1 FROM nd m WHERE m.tree_id = n.tree_id AND m.parent = n.node)"
    return f", c{k} AS ({up_} UNION ALL {bare})"


add("parsimony_root_costs", f"WITH nd AS (SELECT * FROM {{v_nodes}}){_LEVEL}{''.join(_level(k) for k in range(5, 0, -1))} SELECT tree_id, round(c, 9) AS root_cost FROM c1 WHERE h = 'unassigned'",
    lambda s, d: rounded(T.reconstructed(nodes(s, d)), "root_cost").where("node = 1").select("tree_id", "root_cost"))

def rooted(s, d):
    """Rooted on each tree's first tip, without every ninth of the nodes that are tips."""
    tips = nodes(s, d).where("is_tip")
    return G.processed(nodes(s, d), tips.groupBy("tree_id").agg(F.min("node").alias("outgroup")), tips.where("node % 9 = 4").select("tree_id", F.col("node").alias("drop")))


# The way from the outgroup to the old root turns round under a new root; then tips go, and what is left with one branch below merges with it.
_ROOTED = """RECURSIVE nd AS (SELECT * FROM {v_nodes}), og AS (SELECT tree_id, min(node) AS out FROM nd WHERE is_tip GROUP BY tree_id),
pa AS (SELECT og.tree_id, nd.parent AS node, nd.node AS via, 0 AS k FROM og JOIN nd ON nd.tree_id = og.tree_id AND nd.node = og.out UNION ALL SELECT pa.tree_id, nd.parent, nd.node, pa.k + 1 FROM pa JOIN nd ON nd.tree_id = pa.tree_id AND nd.node = pa.node WHERE nd.parent IS NOT NULL),
nr AS (SELECT tree_id, max(node) + 1 AS root FROM nd GROUP BY tree_id),
tu AS (SELECT nd.tree_id, nd.node, CASE WHEN nd.node = og.out OR pa.k = 0 THEN nr.root WHEN pa.k > 0 THEN pa.via ELSE nd.parent END AS parent, CASE WHEN pa.k = 0 THEN 0 WHEN pa.k > 0 THEN v.edge_length ELSE nd.edge_length END AS edge_length
  FROM nd JOIN og ON og.tree_id = nd.tree_id JOIN nr ON nr.tree_id = nd.tree_id LEFT JOIN pa ON pa.tree_id = nd.tree_id AND pa.node = nd.node LEFT JOIN nd v ON v.tree_id = pa.tree_id AND v.node = pa.via UNION ALL SELECT tree_id, root, NULL, 0 FROM nr),
lv AS (SELECT tree_id, node FROM nd n WHERE NOT EXISTS (SELECT 1 FROM nd c WHERE c.tree_id = n.tree_id AND c.parent = n.node) AND NOT (is_tip AND node % 9 = 4)),
us AS (SELECT tree_id, node, node AS anc, 0 AS hops, CAST(0 AS DOUBLE) AS dist FROM tu UNION ALL SELECT us.tree_id, us.node, tu.parent, us.hops + 1, us.dist + tu.edge_length FROM us JOIN tu ON tu.tree_id = us.tree_id AND tu.node = us.anc WHERE tu.parent IS NOT NULL),
fu AS (SELECT DISTINCT us.tree_id, us.anc AS node FROM us JOIN lv ON lv.tree_id = us.tree_id AND lv.node = us.node),
st AS (SELECT tree_id, node FROM lv UNION SELECT tu.tree_id, tu.parent FROM tu JOIN fu ON fu.tree_id = tu.tree_id AND fu.node = tu.node WHERE tu.parent IS NOT NULL GROUP BY tu.tree_id, tu.parent HAVING count(*) > 1)"""
add("trees_rooted", f"WITH {_ROOTED} SELECT st.tree_id, st.node, arg_min(us.anc, us.hops) AS parent, round(coalesce(min(us.dist), 0), 9) AS edge_length FROM st LEFT JOIN (SELECT us.* FROM us JOIN st a ON a.tree_id = us.tree_id AND a.node = us.anc WHERE us.hops > 0) us ON us.tree_id = st.tree_id AND us.node = st.node GROUP BY st.tree_id, st.node",
    lambda s, d: rounded(G.kept(rooted(s, d)), "edge_length"))
add("nodes_of_rooted_trees", f"WITH {_ROOTED} SELECT nd.tree_id, nd.node AS old, m.node FROM nd LEFT JOIN (SELECT us.tree_id, us.anc AS old, arg_min(us.node, us.hops) AS node FROM us JOIN st ON st.tree_id = us.tree_id AND st.node = us.node GROUP BY us.tree_id, us.anc) m ON m.tree_id = nd.tree_id AND m.old = nd.node",
    lambda s, d: rooted(s, d).where("old is not null").select("tree_id", "old", "node"))
add("parsimony_states", None, lambda s, d: rounded(T.reconstructed(nodes(s, d), "s", 2.0, 0.002), "root_cost"))
add("continuation_states", None, lambda s, d: rounded(T.reconstructed(nodes(s, d), "f", 0.05, 5.0), "root_cost"))
add("majority_states", None, lambda s, d: T.reconstructed(nodes(s, d), "r").select("tree_id", "node", "state", "split", "first"))
add("collapsed_trees", None, lambda s, d: rounded(T.collapsed(nodes(s, d), "s", 2.0), "length"))
add("pair_classification", None, lambda s, d: rounded(T.classified(nodes(s, d), "s", 2.0), "min_dist"))
add("split_adjacency", "WITH c AS (SELECT * FROM {v_collapsed}), e AS (SELECT c.tree_id, c.split AS a, p.split AS b, c.host AS ha, p.host AS hb FROM c JOIN c p ON p.tree_id = c.tree_id AND p.split = c.parent_split), b AS (SELECT * FROM e UNION ALL SELECT tree_id, b, a, hb, ha FROM e) SELECT DISTINCT tree_id, ha AS host_1, hb AS host_2 FROM b WHERE ha < hb AND ha <> 'unassigned' AND hb <> 'unassigned' UNION SELECT DISTINCT x.tree_id, x.hb, y.hb FROM b x JOIN b y ON x.tree_id = y.tree_id AND x.a = y.a WHERE x.ha = 'unassigned' AND x.hb < y.hb AND x.hb <> 'unassigned' AND y.hb <> 'unassigned'",
    lambda s, d: T.split_adjacency(view(s, d, "v_collapsed")))
add("split_paths", "WITH RECURSIVE c AS (SELECT * FROM {v_collapsed}), u AS (SELECT tree_id, split, parent_split AS anc FROM c WHERE parent_split IS NOT NULL UNION ALL SELECT u.tree_id, u.split, c.parent_split FROM u JOIN c ON c.tree_id = u.tree_id AND c.split = u.anc WHERE c.parent_split IS NOT NULL) SELECT x.tree_id, y.host AS host_1, x.host AS host_2, count(DISTINCT x.split) AS paths, (SELECT count(*) FROM c z WHERE z.tree_id = x.tree_id AND z.host = x.host) AS nodes FROM u JOIN c x ON x.tree_id = u.tree_id AND x.split = u.split JOIN c y ON y.tree_id = u.tree_id AND y.split = u.anc WHERE x.host <> y.host AND x.host <> 'unassigned' AND y.host <> 'unassigned' GROUP BY x.tree_id, y.host, x.host",
    lambda s, d: T.split_paths(view(s, d, "v_collapsed")))


def subgraphs(s, d):
    """All tips; a host has one subgraph in some trees and up to three in others."""
    return host_tips(s, d).withColumn("subgraph", F.concat("host", F.lit("-SPLIT"), F.when(F.col("tree_id") % 3 == 0, 0).otherwise(F.col("tip") % 3)))


_SUB = TIPS + ", sg AS (SELECT *, host || '-SPLIT' || CASE WHEN tree_id % 3 = 0 THEN '0' ELSE CAST(tip % 3 AS VARCHAR) END AS subgraph FROM tp)"
_SHARES = f"WITH {_SUB}, b AS (SELECT tree_id, host, subgraph, sum(reads) AS r FROM sg GROUP BY tree_id, host, subgraph), sh AS (SELECT *, r / sum(r) OVER (PARTITION BY tree_id, host) AS share, row_number() OVER (PARTITION BY tree_id, host ORDER BY r DESC) AS k FROM b) SELECT tree_id, host, round(sum(CASE WHEN k = 1 THEN share ELSE 0 END), 9) AS p1, round(sum(CASE WHEN k = 2 THEN share ELSE 0 END), 9) AS p2, round(sum(CASE WHEN k = 3 THEN share ELSE 0 END), 9) AS p3 FROM sh GROUP BY tree_id, host"
add("read_proportions", _SHARES, lambda s, d: rounded(T.read_proportions(subgraphs(s, d).withColumnRenamed("subgraph", "split")).select("tree_id", "host", *[F.col("shares")[i].alias(f"p{i + 1}") for i in range(3)]), "p1", "p2", "p3"))
add("tips_and_reads", f"WITH {TIPS} SELECT t.tree_id, h.host, count(tp.tip) AS tips, CAST(coalesce(sum(tp.reads), 0) AS BIGINT) AS reads FROM (SELECT DISTINCT tree_id FROM tp) t CROSS JOIN (SELECT DISTINCT host FROM tp) h LEFT JOIN tp ON tp.tree_id = t.tree_id AND tp.host = h.host GROUP BY t.tree_id, h.host",
    lambda s, d: T.tips_and_reads(host_tips(s, d)))
add("hosts_of_trees", f"WITH {TIPS} SELECT DISTINCT host FROM tp WHERE host IS NOT NULL", lambda s, d: host_tips(s, d).where("host is not null").select("host").distinct())

# Counts repeat within a set, so ties decide too.
_SETS = "SELECT tree_id, node % 6 AS set_id, node AS tip FROM {v_nodes} WHERE is_tip"


def sets(s, d):
    return nodes(s, d).where("is_tip").select("tree_id", (F.col("node") % 6).alias("set_id"), F.col("node").alias("tip"))


add("blacklist_user", f"WITH {TIPS} SELECT tree_id, tip, 'bl_user_specified' AS status FROM tp WHERE tip % 10 = 3", lambda s, d: B.user_specified(host_tips(s, d), host_tips(s, d).where("tip % 10 = 3").select("tree_id", "tip")))
add("blacklist_duplicates", f"WITH {TIPS}, ds AS ({_SETS}), m AS (SELECT ds.set_id, tp.* FROM ds JOIN tp USING (tree_id, tip)) SELECT DISTINCT b.tree_id, b.tip, 'bl_duplicate' AS status FROM m a JOIN m b ON a.tree_id = b.tree_id AND a.set_id = b.set_id AND a.host <> b.host AND (a.reads > b.reads OR a.reads = b.reads AND a.tip < b.tip) WHERE b.reads / a.reads < 0.4 OR b.reads < 4",
    lambda s, d: B.duplicates(host_tips(s, d), sets(s, d), 4, 0.4))
_DUAL = f"WITH {_SUB}, b AS (SELECT host, tree_id, count(DISTINCT subgraph) AS n FROM sg GROUP BY host, tree_id), f AS (SELECT host, count(*) AS trees, count(*) FILTER (n > 1) AS duals, count(*) FILTER (n > 1) / count(*) AS fraction FROM b GROUP BY host)"
add("dual_fractions", f"{_DUAL} SELECT host, trees, duals, round(fraction, 9) AS fraction FROM f", lambda s, d: rounded(B.dual_fraction(subgraphs(s, d)), "fraction"))
add("blacklist_duals", f"{_DUAL}, z AS (SELECT tree_id, host, subgraph, row_number() OVER (PARTITION BY tree_id, host ORDER BY sum(reads) DESC, subgraph DESC) AS k FROM sg GROUP BY tree_id, host, subgraph) SELECT sg.tree_id, sg.tip, 'bl_dual_infection_minor_subgraph' AS status FROM sg JOIN b USING (host, tree_id) JOIN f USING (host) JOIN z ON z.tree_id = sg.tree_id AND z.host = sg.host AND z.subgraph = sg.subgraph WHERE b.n > 1 AND (fraction > 0.8 OR z.k > 1)",
    lambda s, d: B.duals(subgraphs(s, d), 0.8))
add("blacklist_too_few", f"WITH {TIPS} SELECT tree_id, tip, CASE WHEN t < 6 THEN 'bl_too_few_tips' ELSE 'bl_too_few_reads' END AS status FROM (SELECT *, count(*) OVER (PARTITION BY tree_id, host) AS t, sum(reads) OVER (PARTITION BY tree_id, host) AS r FROM tp) x WHERE t < 6 OR r < 16",
    lambda s, d: B.too_few(host_tips(s, d), 6, 16))
add("blacklist_report", f"WITH {TIPS}, u AS (SELECT tree_id, tip, CASE WHEN tip % 10 = 3 THEN 'bl_user_specified' WHEN t < 6 THEN 'bl_too_few_tips' END AS st FROM (SELECT *, count(*) OVER (PARTITION BY tree_id, host) AS t FROM tp) x) SELECT tree_id, tip, st IS NULL AS kept, coalesce(st, 'included') AS status FROM u",
    lambda s, d: B.report(host_tips(s, d), B.too_few(host_tips(s, d), 6), B.user_specified(host_tips(s, d), host_tips(s, d).where("tip % 10 = 3").select("tree_id", "tip"))))
add("downsampled_reads", f"WITH {TIPS} SELECT tree_id, host, least(CAST(sum(reads) AS BIGINT), 7) AS drawn, 0 AS over FROM tp GROUP BY tree_id, host",
    lambda s, d: B.downsampled(host_tips(s, d), 7).join(host_tips(s, d).select("tree_id", "tip", "reads"), ["tree_id", "tip"]).groupBy("tree_id", "host").agg(F.sum("drawn").alias("drawn"), F.count_if((F.col("drawn") < 0) | (F.col("drawn") > F.col("reads"))).cast("int").alias("over")))
add("blacklist_parsimony", None, lambda s, d: B.parsimony_contaminants(nodes(s, d), 3, 0.2, 2.0))


def split_tips(s, d):
    """All tips with hosts, in three subgraphs for each host."""
    return nodes(s, d).where("is_tip and host is not null").select("tree_id", "host", "node", "reads", F.concat("host", F.lit("-SPLIT"), F.col("node") % 3).alias("subgraph"))


def sequences(s, d):
    """An alignment of each tree's tips."""
    return host_tips(s, d).select("tree_id", "tip", F.concat(F.repeat(F.lit("AC"), (F.col("tip") % 5).cast("int")), "host", F.lit("-")).alias("seq"))


_SEQUENCES = "SELECT tree_id, tip, repeat('AC', CAST(tip % 5 AS INT)) || host || '-' AS seq FROM tp"
add("cleaned_alignments", f"WITH {TIPS} SELECT * FROM ({_SEQUENCES}) x WHERE tip % 10 <> 3", lambda s, d: B.cleaned(sequences(s, d), B.report(host_tips(s, d), B.user_specified(host_tips(s, d), host_tips(s, d).where("tip % 10 = 3")))))
add("attached_alignments", f"WITH {TIPS} {_SEQUENCES}", lambda s, d: B.attached(host_tips(s, d), sequences(s, d)))


def listed(s, d):
    return host_tips(s, d).where("tip % 10 = 3").select("tree_id", "tip")


# Each step on what the one before left.
_CHAIN = f"""{_SUB}, bu AS (SELECT tree_id, tip FROM tp WHERE tip % 10 = 3), t1 AS (SELECT * FROM tp ANTI JOIN bu USING (tree_id, tip)),
m AS (SELECT ds.set_id, t1.* FROM ({_SETS}) ds JOIN t1 USING (tree_id, tip)),
bd AS (SELECT DISTINCT b.tree_id, b.tip FROM m a JOIN m b ON a.tree_id = b.tree_id AND a.set_id = b.set_id AND a.host <> b.host AND (a.reads > b.reads OR a.reads = b.reads AND a.tip < b.tip) WHERE b.reads / a.reads < 0.3 OR b.reads < 2),
t2 AS (SELECT * FROM t1 ANTI JOIN bd USING (tree_id, tip)), s2 AS (SELECT * FROM sg SEMI JOIN t2 USING (tree_id, tip)),
z2 AS (SELECT *, sum(n) OVER (PARTITION BY tree_id, host) AS al, count(*) OVER (PARTITION BY tree_id, host) AS k FROM (SELECT tree_id, host, subgraph, sum(reads) AS n FROM s2 GROUP BY tree_id, host, subgraph) x),
bp AS (SELECT s2.tree_id, s2.tip FROM s2 JOIN z2 USING (tree_id, host, subgraph) WHERE n < 2 OR k > 1 AND n / al < 0.3), s3 AS (SELECT * FROM s2 ANTI JOIN bp USING (tree_id, tip)),
z3 AS (SELECT *, count(*) OVER (PARTITION BY tree_id, host) AS k, row_number() OVER (PARTITION BY tree_id, host ORDER BY n DESC, subgraph DESC) AS r FROM (SELECT tree_id, host, subgraph, sum(reads) AS n FROM s3 GROUP BY tree_id, host, subgraph) x),
f3 AS (SELECT host, count(*) FILTER (k > 1) / count(*) AS fraction FROM (SELECT DISTINCT tree_id, host, k FROM z3) x GROUP BY host),
bm AS (SELECT s3.tree_id, s3.tip FROM s3 JOIN z3 USING (tree_id, host, subgraph) JOIN f3 USING (host) WHERE k > 1 AND (fraction > 0.6 OR r > 1)),
t4 AS (SELECT * FROM t2 ANTI JOIN bp USING (tree_id, tip) ANTI JOIN bm USING (tree_id, tip)), bt AS (SELECT tree_id, tip FROM (SELECT *, count(*) OVER (PARTITION BY tree_id, host) AS n FROM t4) x WHERE n < 2),
t5 AS (SELECT * FROM t4 ANTI JOIN bt USING (tree_id, tip)), br AS (SELECT tree_id, tip FROM (SELECT *, sum(reads) OVER (PARTITION BY tree_id, host) AS n FROM t5) x WHERE n < 7),
al AS (SELECT *, 'bl_user_specified' AS status FROM bu UNION ALL SELECT *, 'bl_duplicate' FROM bd UNION ALL SELECT *, 'bl_parsimony_contaminant' FROM bp UNION ALL SELECT *, 'bl_dual_infection_minor_subgraph' FROM bm UNION ALL SELECT *, 'bl_too_few_tips' FROM bt UNION ALL SELECT *, 'bl_too_few_reads' FROM br)"""
add("cleaned_in_order", f"WITH {_CHAIN} SELECT tp.tree_id, tp.tip, status IS NULL AS kept, coalesce(status, 'included') AS status FROM tp LEFT JOIN al USING (tree_id, tip)",
    lambda s, d: B.cleaned_in_order(nodes(s, d), listed(s, d), sets(s, d), 2, 0.3, dual_threshold=0.6, min_tips=2, min_reads=7, splits=subgraphs(s, d)).drop("drawn"))
# The same with the trees' own subgraphs, pruned before they are found, and downsampling.
add("cleaned_trees", None, lambda s, d: B.cleaned_in_order(nodes(s, d), listed(s, d), sets(s, d), 2, 0.3, 2.0, 0.6, 2, 3, 12))
add("subtree_statistics", None, lambda s, d: rounded(S.subtree_statistics(up(s, d), nodes(s, d), split_tips(s, d)), *S.STATISTICS))
add("window_statistics", None, lambda s, d: rounded(S.window_statistics(up(s, d), nodes(s, d), split_tips(s, d), split_tips(s, d), view(s, d, "v_norm").withColumnRenamed("pos", "tree_id")), *S.STATISTICS, *[f"normalised_{c}" for c in S.STATISTICS]))
_ABOVE = "ab AS (SELECT tree_id, node, ancestor FROM up WHERE hops > 0), rc AS (SELECT DISTINCT nd.tree_id, nd.host, ab.ancestor FROM nd JOIN ab USING (tree_id, node) WHERE nd.is_tip AND nd.host IS NOT NULL)"
add("host_descent", f"""{_MRCA}, {_ABOVE}, pr AS (SELECT a.tree_id, a.host AS host_1, b.host AS host_2, a.mrca AS m1, b.mrca AS m2 FROM mr a JOIN mr b ON a.tree_id = b.tree_id AND a.host < b.host WHERE a.host IS NOT NULL AND b.host IS NOT NULL),
    fl AS (SELECT pr.*, EXISTS (SELECT 1 FROM ab WHERE ab.tree_id = pr.tree_id AND ab.node = m2 AND ab.ancestor = m1) AS o1, EXISTS (SELECT 1 FROM ab WHERE ab.tree_id = pr.tree_id AND ab.node = m1 AND ab.ancestor = m2) AS o2,
    EXISTS (SELECT 1 FROM rc WHERE rc.tree_id = pr.tree_id AND rc.host = host_1 AND rc.ancestor = m2) AS r1, EXISTS (SELECT 1 FROM rc WHERE rc.tree_id = pr.tree_id AND rc.host = host_2 AND rc.ancestor = m1) AS r2 FROM pr)
    SELECT tree_id, host_1, host_2, o1 AND NOT r1 AS descends_12, o2 AND NOT r2 AS descends_21, m1 = m2 OR o1 AND r1 OR o2 AND r2 AS intermingled FROM fl""", lambda s, d: S.host_descent(up(s, d), split_tips(s, d)))
# The way to the root: its nodes are those above.
add("paths_around_nodes", f"WITH {UP}, q AS (SELECT tree_id, node AS node_1, CAST(1 AS BIGINT) AS node_2, greatest(1, node // 4) AS node_3 FROM nd WHERE parent IS NOT NULL) SELECT q.*, node_1 = node_2 OR node_3 = node_2 OR NOT EXISTS (SELECT 1 FROM up WHERE up.tree_id = q.tree_id AND up.node = node_1 AND up.ancestor = node_3) AS open FROM q", lambda s, d: S.path_exists(up(s, d), nodes(s, d).where("parent is not null").select("tree_id", F.col("node").alias("node_1"), F.lit(1).cast("long").alias("node_2"), F.greatest(F.lit(1), F.floor(F.col("node") / 4)).alias("node_3"))))
add("reachable_tips", f"WITH {UP}, pt AS (SELECT up.tree_id, up.node, arg_min(up.ancestor, up.hops) AS part FROM up WHERE up.ancestor = 1 OR up.ancestor % 5 = 2 GROUP BY up.tree_id, up.node) SELECT a.tree_id, a.node AS start, b.node AS tip FROM pt a JOIN pt b ON a.tree_id = b.tree_id AND a.part = b.part JOIN nd x ON x.tree_id = a.tree_id AND x.node = a.node JOIN nd y ON y.tree_id = b.tree_id AND y.node = b.node WHERE NOT x.is_tip AND y.is_tip", lambda s, d: S.reachable_tips(up(s, d), nodes(s, d), nodes(s, d).where("node % 5 = 2").select("tree_id", "node"), nodes(s, d).where("not is_tip").select("tree_id", F.col("node").alias("start"))))

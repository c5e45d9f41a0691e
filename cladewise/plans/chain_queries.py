"""From trees to counts of relationships in one run, with SQL of the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R
from ..operators import trees as T
from .relation_queries import CATS, CHUNKS, COUNTS, rounded
from .views import oracle, view

QUERIES, ORACLE = {}, {}


def add(name, sql, run):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = oracle(sql)


def states(s, d):
    return view(s, d, "v_states")


def spans(s, d):
    """A window for each tree."""
    return states(s, d).select("tree_id").distinct().selectExpr("tree_id", "1 + 25 * tree_id AS w_start", "60 + 25 * tree_id AS w_end")


def constants(s, d):
    """Trees without a constant have 1."""
    return view(s, d, "v_norm").where("pos % 4 > 0").select(F.col("pos").alias("tree_id"), "norm_const")


def windows(s, d):
    """Classifications as three kinds of files have them: plain, under another name and turned round, and with a distance that is normalised already."""
    rows = T._cut(T.classified_states(states(s, d)))  # read by each of the three kinds
    turned = {"host_1": "host_2", "host_2": "host_1", "paths12": "paths21", "paths21": "paths12", "nodes1": "nodes2", "nodes2": "nodes1"}
    back = F.when(F.col("ancestry") == "anc", "desc").when(F.col("ancestry") == "desc", "anc").otherwise(F.col("ancestry"))
    return [
        rows.where("tree_id % 3 = 0"),
        rows.where("tree_id % 3 = 1").select("tree_id", *[F.col(a).alias(b) for a, b in turned.items()], "adjacent", "contiguous", "min_dist", back.alias("path_classification")),
        rows.where("tree_id % 3 = 2").withColumn("norm_min_dist", F.col("min_dist") / 2),
    ]


# Regions of one state are subgraphs; what lies between two of them are the subgraphs on the way over the nearest one above both.
CLASSIFIED = """RECURSIVE nd AS (SELECT * FROM {v_states}),
up AS (SELECT tree_id, node, node AS ancestor, 0 AS hops, 0e0 AS dist FROM nd UNION ALL SELECT up.tree_id, up.node, nd.parent, up.hops + 1, up.dist + nd.edge_length FROM up JOIN nd ON nd.tree_id = up.tree_id AND nd.node = up.ancestor WHERE nd.parent IS NOT NULL),
fs AS (SELECT n.*, p.state IS NULL OR p.state <> n.state AS is_first FROM nd n LEFT JOIN nd p ON p.tree_id = n.tree_id AND p.node = n.parent),
sg AS (SELECT up.tree_id, up.node, arg_min(up.ancestor, up.hops) AS sub FROM up JOIN fs ON fs.tree_id = up.tree_id AND fs.node = up.ancestor WHERE fs.is_first GROUP BY up.tree_id, up.node),
sp AS (SELECT fs.tree_id, fs.node AS sub, fs.state AS host, sg.sub AS par FROM fs LEFT JOIN sg ON sg.tree_id = fs.tree_id AND sg.node = fs.parent WHERE fs.is_first),
su AS (SELECT tree_id, sub, sub AS anc, 0 AS hops FROM sp UNION ALL SELECT su.tree_id, su.sub, sp.par, su.hops + 1 FROM su JOIN sp ON sp.tree_id = su.tree_id AND sp.sub = su.anc WHERE sp.par IS NOT NULL),
pr AS (SELECT a.tree_id, a.host AS host_1, b.host AS host_2, a.sub AS a, b.sub AS b FROM sp a JOIN sp b ON a.tree_id = b.tree_id AND a.host < b.host WHERE a.host <> 'unassigned' AND b.host <> 'unassigned'),
lc AS (SELECT pr.*, x.anc AS met, x.hops AS ha, y.hops AS hb FROM pr JOIN su x ON x.tree_id = pr.tree_id AND x.sub = pr.a JOIN su y ON y.tree_id = pr.tree_id AND y.sub = pr.b AND y.anc = x.anc
  QUALIFY row_number() OVER (PARTITION BY pr.tree_id, pr.a, pr.b ORDER BY x.hops) = 1),
way AS (SELECT lc.tree_id, a, b, anc FROM lc JOIN su ON su.tree_id = lc.tree_id AND su.sub = lc.a AND su.hops BETWEEN 1 AND ha - 1 UNION ALL SELECT lc.tree_id, a, b, anc FROM lc JOIN su ON su.tree_id = lc.tree_id AND su.sub = lc.b AND su.hops BETWEEN 1 AND hb - 1
  UNION ALL SELECT tree_id, a, b, met FROM lc WHERE met <> a AND met <> b),
inn AS (SELECT way.tree_id, way.a, way.b, count(*) AS n, count(*) FILTER (sp.host = 'unassigned') AS free, count(*) FILTER (sp.host = sa.host OR sp.host = sb.host) AS own
  FROM way JOIN sp ON sp.tree_id = way.tree_id AND sp.sub = way.anc JOIN sp sa ON sa.tree_id = way.tree_id AND sa.sub = way.a JOIN sp sb ON sb.tree_id = way.tree_id AND sb.sub = way.b GROUP BY way.tree_id, way.a, way.b),
far AS (SELECT lc.tree_id, lc.a, lc.b, min(x.dist + y.dist) AS dist FROM lc JOIN up x ON x.tree_id = lc.tree_id AND x.node = lc.a JOIN up y ON y.tree_id = lc.tree_id AND y.node = lc.b AND y.ancestor = x.ancestor GROUP BY lc.tree_id, lc.a, lc.b),
nest AS (SELECT lc.tree_id, lc.a, lc.b, min(up.dist) AS dist FROM lc JOIN up ON up.tree_id = lc.tree_id AND up.node = CASE WHEN met = a THEN b ELSE a END JOIN sg ON sg.tree_id = up.tree_id AND sg.node = up.ancestor AND sg.sub = lc.met WHERE met = a OR met = b GROUP BY lc.tree_id, lc.a, lc.b),
hp AS (SELECT lc.tree_id, host_1, host_2, bool_or(coalesce(inn.n, 0) = 0 OR inn.n = 1 AND inn.free = 1) AS adjacent, bool_and(coalesce(inn.n, 0) = coalesce(inn.free + inn.own, 0)) AS contiguous,
  coalesce(min(coalesce(nest.dist, far.dist)) FILTER (coalesce(inn.own, 0) = 0), CAST('inf' AS DOUBLE)) AS min_dist
  FROM lc LEFT JOIN inn USING (tree_id, a, b) JOIN far USING (tree_id, a, b) LEFT JOIN nest USING (tree_id, a, b) GROUP BY lc.tree_id, host_1, host_2),
pt AS (SELECT x.tree_id, y.host AS over, x.host AS under, count(DISTINCT x.sub) AS n FROM su JOIN sp x ON x.tree_id = su.tree_id AND x.sub = su.sub JOIN sp y ON y.tree_id = su.tree_id AND y.sub = su.anc WHERE x.host <> y.host GROUP BY x.tree_id, y.host, x.host),
sz AS (SELECT tree_id, host, count(*) AS n FROM sp GROUP BY tree_id, host),
cn AS (SELECT hp.*, coalesce(p.n, 0) AS paths12, coalesce(q.n, 0) AS paths21, z1.n AS nodes1, z2.n AS nodes2 FROM hp LEFT JOIN pt p ON p.tree_id = hp.tree_id AND p.over = host_1 AND p.under = host_2 LEFT JOIN pt q ON q.tree_id = hp.tree_id AND q.over = host_2 AND q.under = host_1
  JOIN sz z1 ON z1.tree_id = hp.tree_id AND z1.host = host_1 JOIN sz z2 ON z2.tree_id = hp.tree_id AND z2.host = host_2),
cl AS (SELECT tree_id, host_1, host_2, adjacent, contiguous, paths12, paths21, nodes1, nodes2, CASE WHEN paths12 + paths21 = 0 THEN 'noAncestry' WHEN paths21 = 0 AND paths12 = nodes2 AND paths12 = 1 THEN 'anc' WHEN paths12 = 0 AND paths21 = nodes1 AND paths21 = 1 THEN 'desc' ELSE 'complex' END AS ancestry, min_dist FROM cn)"""

add("classified_states", f"WITH {CLASSIFIED} SELECT tree_id, host_1, host_2, adjacent, contiguous, paths12, paths21, nodes1, nodes2, ancestry, round(min_dist, 9) AS min_dist FROM cl", lambda s, d: rounded(T.classified_states(states(s, d)), "min_dist"))

# A tree's constant is 1 without a row, and 2 where the distance comes normalised.
_PAIRS = ", pairs_of_trees AS (SELECT cl.*, 1 + 25 * cl.tree_id AS w_start, 60 + 25 * cl.tree_id AS w_end, CASE WHEN cl.tree_id % 3 = 2 THEN 2 WHEN pos % 4 > 0 THEN v.norm_const ELSE 1 END AS norm_const FROM cl LEFT JOIN {v_norm} v ON v.pos = cl.tree_id)"
_COUNTS = f"WITH {CLASSIFIED}{_PAIRS}, {CATS.replace('{v_pairs}', 'pairs_of_trees')}{CHUNKS}{COUNTS}"
add("counts_of_trees", f"{_COUNTS} SELECT host_1, host_2, categorisation, dist_level, type, k, round(k_eff, 9) AS k_eff, n, round(n_eff, 9) AS n_eff, round(score, 9) AS score FROM sc",
    lambda s, d: rounded(R.counts_of_windows(windows(s, d), spans(s, d), constants(s, d)), "k_eff", "n_eff", "score"))
# The same from the reconstruction of states on; its costs are learnt from no table that SQL could follow.
add("counts_of_reconstructed_trees", None, lambda s, d: rounded(R.counts_of_windows([T.classified(view(s, d, "v_nodes"), "s", 2.0)], spans(s, d), constants(s, d)), "k_eff", "n_eff", "score"))
add("merged_classifications", f"WITH {CLASSIFIED}{_PAIRS} SELECT tree_id, host_1, host_2, adjacent, contiguous, paths12, paths21, nodes1, nodes2, ancestry, round(min_dist / norm_const, 9) AS dist FROM pairs_of_trees",
    lambda s, d: rounded(R.merged(windows(s, d), constants(s, d)).drop("min_dist"), "dist"))

"""Queries over pairs of hosts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R
from .views import oracle, view

QUERIES, ORACLE = {}, {}


def add(name, sql, run):
    QUERIES[name], ORACLE[name] = run, oracle(sql)


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


def pairs(s, d):
    return R.with_distance(view(s, d, "v_pairs"))


def dwin(s, d):
    return R.categorised(pairs(s, d))


# The categories as SQL; a query's WITH list goes on after it.
CATS = """d AS (SELECT *, min_dist / norm_const AS dist FROM {v_pairs}),
e AS (SELECT *, CASE WHEN dist < 0.025 THEN 'close' WHEN dist >= 0.05 THEN 'distant' ELSE 'intermediate' END AS cat_dist,
  CASE WHEN NOT adjacent THEN 'other' ELSE (CASE WHEN ancestry IN ('anc', 'multiAnc') THEN 'anc' WHEN ancestry IN ('desc', 'multiDesc') THEN 'desc' WHEN ancestry = 'complex' THEN 'intermingled' ELSE 'sibling' END)
  || CASE WHEN contiguous THEN '_contiguous' ELSE '_noncontiguous' END END AS basic FROM d),
w AS (SELECT *, cat_dist AS proximity_3_way_cat,
  CASE WHEN contiguous AND (basic LIKE 'anc%' OR basic LIKE 'desc%' OR basic LIKE 'intermingled%') THEN 'anc.or.complex' ELSE 'other' END AS any_ancestry_cat,
  CASE WHEN contiguous AND cat_dist = 'close' THEN 'contiguous_close' WHEN contiguous THEN 'contiguous_not.close' WHEN cat_dist = 'close' THEN 'noncontiguous_close' ELSE 'not.close.other' END AS close_x_contiguous_cat,
  CASE WHEN cat_dist = 'close' AND adjacent THEN 'close.and.adjacent' ELSE 'not.close.or.nonadjacent' END AS close_and_adjacent_cat,
  CASE WHEN cat_dist = 'close' AND contiguous THEN 'close.and.contiguous' ELSE 'not.close.or.noncontiguous' END AS close_and_contiguous_cat,
  CASE WHEN NOT (cat_dist = 'close' AND adjacent) THEN 'not.close.or.nonadjacent' WHEN basic LIKE 'anc%' THEN '12' WHEN basic LIKE 'desc%' THEN '21' ELSE 'complex.or.no.ancestry' END AS close_and_adjacent_and_ancestry_cat,
  CASE WHEN NOT (cat_dist = 'close' AND contiguous) THEN 'not.close.or.noncontiguous' WHEN basic LIKE 'anc%' THEN '12' WHEN basic LIKE 'desc%' THEN '21' ELSE 'complex.or.no.ancestry' END AS close_and_contiguous_and_ancestry_cat,
  CASE WHEN cat_dist = 'close' AND adjacent AND basic LIKE 'anc%' THEN '12' WHEN cat_dist = 'close' AND adjacent AND basic LIKE 'desc%' THEN '21' END AS close_and_adjacent_and_directed_cat,
  CASE WHEN cat_dist = 'close' AND contiguous AND basic LIKE 'anc%' THEN '12' WHEN cat_dist = 'close' AND contiguous AND basic LIKE 'desc%' THEN '21' END AS close_and_contiguous_and_directed_cat FROM e)"""
CHUNKS = """, sl AS (SELECT coalesce(min(step), 1) AS slide FROM (SELECT w_start - lag(w_start) OVER (PARTITION BY host_1, host_2 ORDER BY w_start) AS step FROM w) x),
ch AS (SELECT *, sum(new) OVER (PARTITION BY host_1, host_2 ORDER BY w_start ROWS UNBOUNDED PRECEDING) AS chunk FROM (
  SELECT w.*, CASE WHEN lag(w_start) OVER (PARTITION BY host_1, host_2 ORDER BY w_start) = w_start - slide THEN 0 ELSE 1 END AS new FROM w, sl) x),
ef AS (SELECT *, count(*) OVER (PARTITION BY host_1, host_2, chunk) AS n_windows,
  (max(w_end) OVER (PARTITION BY host_1, host_2, chunk) + 1 - min(w_start) OVER (PARTITION BY host_1, host_2, chunk)) / (w_end + 1 - w_start) AS effective_n FROM ch)"""
_LONG = " UNION ALL ".join(["SELECT host_1, host_2, 'basic' AS categorisation, cat_dist AS dist_level, basic AS type, n_windows, effective_n FROM ef", *[f"SELECT host_1, host_2, '{c}', CAST(NULL AS VARCHAR), {c}, n_windows, effective_n FROM ef WHERE {c} IS NOT NULL" for c in R.CATEGORIES]])
COUNTS = f""", lg AS ({_LONG}),
gr AS (SELECT host_1, host_2, categorisation, dist_level, type, count(*) AS k, sum(effective_n / n_windows) AS k_eff FROM lg GROUP BY 1, 2, 3, 4, 5),
fu AS (SELECT p.host_1, p.host_2, t.categorisation, t.dist_level, t.type, coalesce(k, 0) AS k, coalesce(k_eff, 0) AS k_eff
  FROM (SELECT DISTINCT host_1, host_2 FROM gr) p CROSS JOIN (SELECT DISTINCT categorisation, dist_level, type FROM gr) t
  LEFT JOIN gr g ON g.host_1 = p.host_1 AND g.host_2 = p.host_2 AND g.categorisation = t.categorisation AND g.dist_level IS NOT DISTINCT FROM t.dist_level AND g.type = t.type),
dc AS (SELECT *, CAST(sum(k) OVER (PARTITION BY host_1, host_2, categorisation) AS BIGINT) AS n, sum(k_eff) OVER (PARTITION BY host_1, host_2, categorisation) AS n_eff FROM fu),
sc AS (SELECT *, k_eff / nullif(n_eff, 0) AS score FROM dc)"""
SCORES = f"WITH {CATS}{CHUNKS}{COUNTS}"

add("pair_categories", f"WITH {CATS} SELECT tree_id, host_1, host_2, round(dist, 9) AS dist, cat_dist, basic, {', '.join(R.CATEGORIES)} FROM w",
    lambda s, d: rounded(dwin(s, d), "dist").select("tree_id", "host_1", "host_2", "dist", "cat_dist", "basic", *R.CATEGORIES))
# A third of the pairs come the other way round.
add("pair_orientation", """WITH x AS (SELECT tree_id, CASE WHEN (paths12 + nodes1) % 3 = 0 THEN host_2 ELSE host_1 END AS a, CASE WHEN (paths12 + nodes1) % 3 = 0 THEN host_1 ELSE host_2 END AS b, paths12, paths21, nodes1, nodes2, ancestry FROM {v_pairs})
    SELECT tree_id, least(a, b) AS host_1, greatest(a, b) AS host_2, CASE WHEN b < a THEN paths21 ELSE paths12 END AS paths12, CASE WHEN b < a THEN paths12 ELSE paths21 END AS paths21, CASE WHEN b < a THEN nodes2 ELSE nodes1 END AS nodes1, CASE WHEN b < a THEN nodes1 ELSE nodes2 END AS nodes2,
    CASE WHEN b > a THEN ancestry WHEN ancestry = 'anc' THEN 'desc' WHEN ancestry = 'desc' THEN 'anc' WHEN ancestry = 'multiAnc' THEN 'multiDesc' WHEN ancestry = 'multiDesc' THEN 'multiAnc' ELSE ancestry END AS ancestry FROM x""",
    lambda s, d: R.oriented(view(s, d, "v_pairs").withColumn("turn", (F.col("paths12") + F.col("nodes1")) % 3 == 0).select("tree_id", F.when(F.col("turn"), F.col("host_2")).otherwise(F.col("host_1")).alias("host_1"), F.when(F.col("turn"), F.col("host_1")).otherwise(F.col("host_2")).alias("host_2"), "paths12", "paths21", "nodes1", "nodes2", "ancestry")))
add("pair_plot_labels", f"WITH {CATS} SELECT tree_id, host_1, host_2, CASE WHEN basic LIKE 'anc\\_%' ESCAPE '\\' THEN 'ancestral' WHEN basic LIKE 'desc\\_%' ESCAPE '\\' THEN 'descendant' WHEN basic LIKE 'sib%' THEN 'sibling' WHEN basic LIKE 'int%' THEN 'intermingled' ELSE 'other' END AS topology, round(greatest(dist, 0.001), 9) AS shown_dist FROM w",
    lambda s, d: rounded(R.plot_labels(dwin(s, d)), "shown_dist").select("tree_id", "host_1", "host_2", "topology", "shown_dist"))
add("pairs_with_enough_reads", """SELECT p.tree_id, p.host_1, p.host_2, h1.reads AS reads_1, h1.tips AS tips_1, h2.reads AS reads_2, h2.tips AS tips_2 FROM {v_pairs} p JOIN {v_hosts} h1 ON h1.tree_id = p.tree_id AND h1.host = p.host_1
    JOIN {v_hosts} h2 ON h2.tree_id = p.tree_id AND h2.host = p.host_2 WHERE h1.reads >= 8 AND h2.reads >= 8 AND h1.tips >= 3 AND h2.tips >= 3""",
    lambda s, d: (lambda h, p: p.join(h.select("tree_id", F.col("host").alias("host_1"), F.col("reads").alias("reads_1"), F.col("tips").alias("tips_1")), ["tree_id", "host_1"]).join(h.select("tree_id", F.col("host").alias("host_2"), F.col("reads").alias("reads_2"), F.col("tips").alias("tips_2")), ["tree_id", "host_2"]))(view(s, d, "v_hosts"), R.with_enough(view(s, d, "v_pairs").select("tree_id", "host_1", "host_2"), view(s, d, "v_hosts"), 8, 3)))
add("window_slide", f"WITH {CATS}{CHUNKS} SELECT slide FROM sl", lambda s, d: R.slide(pairs(s, d)))
add("window_chunks", f"WITH {CATS}{CHUNKS} SELECT tree_id, host_1, host_2, CAST(chunk AS BIGINT) AS chunk, n_windows, round(effective_n, 9) AS effective_n FROM ef",
    lambda s, d: rounded(R.chunked(pairs(s, d)), "effective_n").select("tree_id", "host_1", "host_2", F.col("chunk").cast("long").alias("chunk"), "n_windows", "effective_n"))
add("relationship_scores", f"{SCORES} SELECT host_1, host_2, categorisation, dist_level, type, k, round(k_eff, 9) AS k_eff, n, round(n_eff, 9) AS n_eff, round(score, 9) AS score FROM sc",
    lambda s, d: rounded(R.counts(dwin(s, d)), "k_eff", "n_eff", "score"))

_SUMMARY = """, su AS (SELECT DISTINCT CASE WHEN ancestry IN ('desc', 'multiDesc') THEN host_2 ELSE host_1 END AS host_1, CASE WHEN ancestry IN ('desc', 'multiDesc') THEN host_1 ELSE host_2 END AS host_2,
  CASE WHEN ancestry IN ('anc', 'desc') THEN 'trans' WHEN ancestry IN ('multiAnc', 'multiDesc') THEN 'multiTrans' ELSE ancestry END AS ancestry, n AS ancestry_tree_count, both_exist, CAST(n AS VARCHAR) || '/' || CAST(both_exist AS VARCHAR) AS fraction, CAST(any_n AS BIGINT) AS any_relationship_tree_count
  FROM (SELECT *, sum(n) OVER (PARTITION BY host_1, host_2) AS any_n FROM (SELECT host_1, host_2, ancestry, both_exist, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY host_1, host_2) AS both_exist FROM d) q WHERE {cond} GROUP BY 1, 2, 3, 4) g) h WHERE any_n > 1)"""


def _summary(cond):
    return _SUMMARY.replace("{cond}", cond)


_D = CATS.split(",\ne AS")[0]
add("transmission_summary", f"WITH {_D}{_summary('adjacent AND dist < 0.06')} SELECT * FROM su", lambda s, d: R.summary(pairs(s, d), 1, 0.06))
add("transmission_summary_close_siblings", f"WITH {_D}{_summary(chr(99) + 'ontiguous AND (dist < 0.03 OR ancestry <> ' + chr(39) + 'noAncestry' + chr(39) + ')')} SELECT * FROM su", lambda s, d: R.summary(pairs(s, d), 1, 0.03, close_sib_only=True, contiguous=True))
_TEXT = "regexp_replace(regexp_replace(CAST(CAST(round_even(round(({x}) * 1000, 6) / 10, 0) / 100 AS DECIMAL(20,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_ARROW = "SELECT CASE WHEN shown AND total_12 <= total_21 THEN host_2 ELSE host_1 END AS host_1, CASE WHEN shown AND total_12 <= total_21 THEN host_1 ELSE host_2 END AS host_2, shown AS arrow, CASE WHEN shown THEN " + _TEXT.replace("{x}", "greatest(total_12, total_21) / TT") + " || '/' ELSE '' END || " + _TEXT.replace("{x}", "total / TT") + " AS label FROM (SELECT *, (total_12 >= AT * TT OR total_21 >= AT * TT) AS shown FROM (SELECT *, total_12 + total_21 + total_equiv AS total FROM wi) a) b"
add("simplified_summary", f"""WITH {_D}{_summary('adjacent AND dist < 0.06')}, wi AS (SELECT least(host_1, host_2) AS host_1, greatest(host_1, host_2) AS host_2,
  coalesce(sum(CASE WHEN ancestry IN ('trans', 'multiTrans') AND host_1 < host_2 THEN ancestry_tree_count END), 0) AS total_12, coalesce(sum(CASE WHEN ancestry IN ('trans', 'multiTrans') AND host_1 > host_2 THEN ancestry_tree_count END), 0) AS total_21,
  coalesce(sum(CASE WHEN ancestry = 'complex' THEN ancestry_tree_count END), 0) AS total_equiv FROM su GROUP BY least(host_1, host_2), greatest(host_1, host_2)) """ + _ARROW.replace("AT", "0.15").replace("TT", "40.0"),
    lambda s, d: R.simplified(R.summary(pairs(s, d), 1, 0.06), 0.15, 40))
add("simplified_multinomial", f"""{SCORES}, wi AS (SELECT * FROM (SELECT host_1, host_2, coalesce(sum(CASE WHEN type = '12' THEN score END), 0) AS total_12, coalesce(sum(CASE WHEN type = '21' THEN score END), 0) AS total_21,
  coalesce(sum(CASE WHEN type LIKE 'complex%' THEN score END), 0) AS total_equiv FROM sc WHERE categorisation = 'close_and_adjacent_and_ancestry_cat' AND type NOT LIKE 'not.close%' GROUP BY 1, 2) x WHERE total_12 + total_21 + total_equiv >= 0.2)
  """ + _ARROW.replace("AT", "0.13").replace("TT", "1.0"),
    lambda s, d: R.simplified_multinomial(R.counts(dwin(s, d)), 0.2, 0.13))

"""Queries of networks and flows, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows as W
from ..operators import networks as N
from ..operators import trees as T
from ..operators import relations as R
from .relation_queries import SCORES, dwin, rounded
from .views import oracle, view

QUERIES, ORACLE = {}, {}


def add(name, sql, run):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = oracle(sql)


def dc(s, d):
    return R.counts(dwin(s, d))


_LINKED = ", lk AS (SELECT host_1, host_2 FROM sc WHERE categorisation = 'close_and_adjacent_cat' AND type = 'close.and.adjacent' AND n_eff > 8 AND score > 0.25)"


def linked(s, d):
    return dc(s, d).where("categorisation = 'close_and_adjacent_cat' and type = 'close.and.adjacent' and n_eff > 8 and score > 0.25").select("host_1", "host_2")


add("linked_pairs", f"{SCORES} SELECT y.host_1, y.host_2, y.k, round(y.k_eff, 9) AS k_eff, round(y.n_eff, 9) AS n_eff FROM sc y JOIN sc x ON x.host_1 = y.host_1 AND x.host_2 = y.host_2 AND x.categorisation = 'close_and_adjacent_cat' AND x.type = 'not.close.or.nonadjacent' WHERE y.categorisation = 'close_and_adjacent_cat' AND y.type = 'close.and.adjacent' AND x.n_eff >= 3 AND x.k_eff / x.n_eff < 0.7 AND y.k_eff / y.n_eff > 0",
    lambda s, d: rounded(N.linked_pairs(dc(s, d), 3, 0.7), "k_eff", "n_eff").select("host_1", "host_2", "k", "k_eff", "n_eff"))
add("pairs_with_metadata", f"{SCORES}{_LINKED} SELECT lk.host_1, lk.host_2, a.name AS h1_name, a.region AS h1_region, b.name AS h2_name, b.region AS h2_region FROM lk LEFT JOIN {{v_meta}} a ON a.id = lk.host_1 LEFT JOIN {{v_meta}} b ON b.id = lk.host_2",
    lambda s, d: N.with_metadata(linked(s, d), view(s, d, "v_meta")))
add("pairs_with_repeated_metadata", f"{SCORES}{_LINKED}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name, region) AS k FROM {{v_meta_twice}}) x WHERE k = 1) SELECT lk.host_1, lk.host_2, a.name AS h1_name, a.region AS h1_region, b.name AS h2_name, b.region AS h2_region FROM lk LEFT JOIN m a ON a.id = lk.host_1 LEFT JOIN m b ON b.id = lk.host_2",
    lambda s, d: N.with_metadata(linked(s, d), view(s, d, "v_meta_twice")))
add("network_components", SCORES.replace("WITH ", "WITH RECURSIVE ", 1) + _LINKED + ", ed AS (SELECT host_1 AS a, host_2 AS b FROM lk UNION SELECT host_2, host_1 FROM lk), rc AS (SELECT DISTINCT a AS id, a AS label FROM ed UNION SELECT ed.b, rc.label FROM rc JOIN ed ON ed.a = rc.id) SELECT id, min(label) AS label FROM rc GROUP BY id",
    lambda s, d: N.components(linked(s, d)))
def most_likely_chains(s, d):
    c = T._cut(dc(s, d))  # read by the networks, their edges and the scores
    nets = T._cut(N.networks(c, 8))
    found = N.decorated(N.chains(N.directions(N.network_edges(c, nets, 8))), c)
    return rounded(found.select("network", "host_1", "host_2", "link_12", "link_21", "score_linked", "score_dir_12", "score_dir_21", "score_nw_12", "score_nw_21"), "score_linked", "score_dir_12", "score_dir_21", "score_nw_12", "score_nw_21")


add("most_likely_chains", None, most_likely_chains)
# Components by rounds of joins as well, as for links that no task can hold.
add("network_components_by_rounds", ORACLE["network_components"], lambda s, d: N.components(linked(s, d), most=0))


def draws(s, d):
    return view(s, d, "v_draws")


def target(df):
    return df.select("pair_id").distinct().select("pair_id", F.concat(F.lit("g"), F.col("pair_id") % 3).alias("source"), F.concat(F.lit("g"), F.floor(F.col("pair_id") / 3) % 2).alias("recipient"))


def flows(s, d):
    return W.to_target(draws(s, d), target(draws(s, d)))


_FLOWS = "fl AS (SELECT sample, 'g' || CAST(pair_id % 3 AS VARCHAR) AS source, 'g' || CAST(CAST(floor(pair_id / 3) AS BIGINT) % 2 AS VARCHAR) AS recipient, sum(exp(value)) AS value FROM {v_draws} GROUP BY 1, 2, 3)"
_Q = ", ".join(f"round(quantile_cont(value, {p}), 9) AS {n}" for n, p in W.QUANTILES.items())
add("flow_sums", f"WITH {_FLOWS} SELECT sample, source, recipient, round(value, 6) AS value FROM fl", lambda s, d: rounded(flows(s, d), "value", digits=6))
add("flow_log_sums", f"WITH {_FLOWS} SELECT source, recipient, round(ln(sum(value)), 9) AS value FROM fl GROUP BY source, recipient", lambda s, d: rounded(W.log_sums(draws(s, d).join(target(draws(s, d)), "pair_id"), "source", "recipient"), "value"))
add("flow_proportions", f"WITH {_FLOWS} SELECT source, recipient, {_Q} FROM (SELECT source, recipient, value / sum(value) OVER (PARTITION BY sample) AS value FROM fl) x GROUP BY source, recipient",
    lambda s, d: rounded(W.quantiles(W.proportions(flows(s, d)), "source", "recipient"), *W.QUANTILES))
add("flow_waifm", f"WITH {_FLOWS} SELECT source, recipient, {_Q} FROM (SELECT source, recipient, value / sum(value) OVER (PARTITION BY sample, source) AS value FROM fl) x GROUP BY source, recipient", lambda s, d: rounded(W.waifm(flows(s, d)), *W.QUANTILES))
add("flow_sources", f"WITH {_FLOWS} SELECT source, recipient, {_Q} FROM (SELECT source, recipient, value / sum(value) OVER (PARTITION BY sample, recipient) AS value FROM fl) x GROUP BY source, recipient", lambda s, d: rounded(W.sources(flows(s, d)), *W.QUANTILES))
add("flow_ratios", f"WITH {_FLOWS}, w AS (SELECT sample, coalesce(sum(CASE WHEN source = 'g0' AND recipient = 'g1' THEN value END), 0) AS a, coalesce(sum(CASE WHEN source = 'g1' AND recipient = 'g0' THEN value END), 0) AS b FROM fl GROUP BY sample) SELECT '01/10' AS ratio, {_Q} FROM (SELECT a / b AS value FROM w WHERE b <> 0) x",
    lambda s, d: rounded(W.ratios(flows(s, d), [("01/10", ("g0", "g1"), ("g1", "g0"))]), *W.QUANTILES))
add("flow_thinning", "SELECT sample, pair_id FROM (SELECT sample, pair_id, dense_rank() OVER (ORDER BY sample) AS r FROM {v_draws}) x WHERE r > floor((SELECT count(DISTINCT sample) FROM {v_draws}) * 0.1) AND (r - floor((SELECT count(DISTINCT sample) FROM {v_draws}) * 0.1) - 1) % 3 = 0",
    lambda s, d: W.thinned(draws(s, d), 0.1, 3).select("sample", "pair_id"))
add("flow_grid", "SELECT s.source, r.recipient, coalesce(o.obs, 0) AS obs FROM (SELECT DISTINCT source FROM {v_dobs_nations}) s CROSS JOIN (SELECT DISTINCT recipient FROM {v_dobs_nations}) r LEFT JOIN {v_dobs_nations} o ON o.source = s.source AND o.recipient = r.recipient",
    lambda s, d: (lambda o: W.grid_counts(o, o, o).select("source", "recipient", "obs"))(view(s, d, "v_dobs_nations")))
add("flow_diagnostics", "SELECT pair_id, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(median(value), 9) AS median, round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper FROM {v_draws} GROUP BY pair_id",
    lambda s, d: rounded(W.diagnostics(draws(s, d), "pair_id"), "mean", "sd", "median", "lower", "upper").drop("ess"))
_PCT = "CAST(CAST(round_even(round({c} * 1000, 6) / 10, 1) AS DECIMAL(20,1)) AS VARCHAR) || '%'"
add("flow_labels", f"WITH {_FLOWS}, q AS (SELECT source, recipient, {_Q} FROM (SELECT source, recipient, value / sum(value) OVER (PARTITION BY sample) AS value FROM fl) x GROUP BY source, recipient) SELECT source, recipient, " + _PCT.replace("{c}", "m") + " || ' [' || " + _PCT.replace("{c}", "cl") + " || ' - ' || " + _PCT.replace("{c}", "cu") + " || ']' AS label FROM q",
    lambda s, d: W.labelled(W.quantiles(W.proportions(flows(s, d)), "source", "recipient")).select("source", "recipient", "label"))
add("flow_lowest", "SELECT pair_id, round(avg(value), 9) AS mean FROM {v_draws} GROUP BY pair_id ORDER BY avg(value) LIMIT 10", lambda s, d: rounded(W.lowest(W.diagnostics(draws(s, d), "pair_id"), "mean"), "mean").select("pair_id", "mean"))
add("flow_errors", "WITH t AS (SELECT pair_id, avg(value) AS truth FROM {v_draws} GROUP BY pair_id) SELECT replicate, round(avg(abs(v - truth)), 9) AS mae, round(max(abs(v - truth)), 9) AS worst FROM (SELECT sample % 5 AS replicate, pair_id, avg(value) AS v FROM {v_draws} GROUP BY sample % 5, pair_id) e JOIN t USING (pair_id) GROUP BY replicate",
    lambda s, d: rounded(W.errors(draws(s, d).groupBy((F.col("sample") % 5).alias("replicate"), "pair_id").agg(F.avg("value").alias("value")), draws(s, d).groupBy("pair_id").agg(F.avg("value").alias("truth")), "pair_id"), "mae", "worst"))
add("distinct_sources", "SELECT b.c_mktsegment AS recipient, count(DISTINCT o_custkey) AS sources FROM orders JOIN customer b ON b.c_custkey = (o_orderkey * 7) % 150 + 1 GROUP BY b.c_mktsegment",
    lambda s, d: (lambda o, c: o.join(c, F.col("c_custkey") == (F.col("o_orderkey") * 7) % 150 + 1).groupBy(F.col("c_mktsegment").alias("recipient")).agg(F.countDistinct("o_custkey").alias("sources")))(view(s, d, "orders"), view(s, d, "customer")))
add("age_bands", "SELECT CAST(floor(p_size / 5) * 5 AS BIGINT) AS band, count(*) AS n FROM part GROUP BY 1", lambda s, d: view(s, d, "part").groupBy(W.band(F.col("p_size"), 5).cast("long").alias("band")).agg(F.count("*").alias("n")))
add("mean_imputed", "SELECT c_custkey, round(coalesce(x, avg(x) OVER (PARTITION BY c_mktsegment), avg(x) OVER ()), 9) AS x FROM (SELECT *, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS x FROM customer) q",
    lambda s, d: rounded(W.imputed(view(s, d, "customer").withColumn("x", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal"))), "x", "c_mktsegment"), "x").select("c_custkey", "x"))
add("flow_posterior", None, lambda s, d: rounded(W.flow_draws(view(s, d, "v_dobs"), view(s, d, "customer").select(F.col("c_mktsegment").alias("category"), (0.2 + (F.col("c_custkey") % 50) / 100).alias("p")).distinct(), 2, 60), "value"))
add("flow_posterior_joint", None, lambda s, d: rounded(W.flow_draws(view(s, d, "v_dobs"), view(s, d, "customer").select(F.col("c_mktsegment").alias("category"), (0.2 + (F.col("c_custkey") % 50) / 100).alias("p")).distinct(), 2, 60, joint=True), "value"))


def priors(s, d):
    """Sampling probabilities of each category, others as a source than as a recipient."""
    p = view(s, d, "customer").select(F.col("c_mktsegment").alias("category"), (0.2 + (F.col("c_custkey") % 50) / 100).alias("p"), F.when(F.col("c_custkey") % 2 == 0, "source").otherwise("recipient").alias("who"))
    return p.withColumn("p", F.when(F.col("who") == "source", F.col("p")).otherwise(F.col("p") / 2)).distinct()


add("flow_posterior_by_role", None, lambda s, d: rounded(W.flow_draws(view(s, d, "v_dobs"), priors(s, d), 2, 60, joint=True), "value"))

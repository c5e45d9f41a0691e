"""Queries of batches, grids, reports and checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as P
from .format_queries import _sql
from .views import oracle, view

_HOSTS = ("H1", "H10", "H12", "H3", "H7", "H99")
_LABELS = "SELECT tree_id, CASE WHEN tree_id % 3 = 0 THEN host ELSE host || '_read_1_count_' || CAST(reads AS @text) END AS label FROM {v_nodes} WHERE is_tip"
#: Metrics of some samples in some windows; all samples are in all windows' lists.
_SAMPLES = "SELECT window_id, id AS sample FROM {v_windows} CROSS JOIN {v_meta}"
_METRICS = "SELECT window_id, sample, ((window_id * 7 + length(sample) * 3 + CAST(substr(sample, 2) AS BIGINT)) % 5) * 25e-2 AS metric FROM (" + _SAMPLES + ") s WHERE (window_id + CAST(substr(sample, 2) AS BIGINT)) % 4 > 0"


def batched_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.batched(_sql(spark, sf_dir, "SELECT id AS ind FROM {v_meta_twice}"), 4)


def grid_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "v_pairs").withColumn("dist", F.col("min_dist") / F.col("norm_const"))
    return P.pair_grid(pairs, _HOSTS, view(spark, sf_dir, "v_hosts"), 0.04)


def recombination_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.recombination_report(_sql(spark, sf_dir, _METRICS), _sql(spark, sf_dir, _SAMPLES))


def trees_with_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.have_read_counts(_sql(spark, sf_dir, _LABELS), "^.*_read_[0-9]+_count_([0-9]+)$")


def names_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _sql(spark, sf_dir, "SELECT DISTINCT 'H' || substr(sample, 2) AS name FROM {v_reads}")
    two = _sql(spark, sf_dir, "SELECT id AS name FROM {v_meta} WHERE length(name) % 4 > 0")
    return P.same_names(one, two)


def statistics_with_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _sql(spark, sf_dir, "SELECT tree_id, host, CAST(floor(node / 4) AS BIGINT) AS subgraph, reads FROM {v_nodes} WHERE is_tip")
    statistics = splits.groupBy("tree_id", "host").agg(F.count("*").alias("tips"))
    rows = P.with_proportions(statistics, splits)
    return rows.select("tree_id", "host", "tips", F.size("proportions").cast("long").alias("subgraphs"), F.round(F.col("proportions")[0], 9).alias("largest"), F.round(F.element_at("proportions", -1), 9).alias("smallest"))


QUERIES = {f.__name__: f for f in (batched_individuals, grid_of_pairs, recombination_lines, trees_with_read_counts, names_of_both, statistics_with_proportions)}

_LIST = ", ".join(f"('{h}')" for h in _HOSTS)
ORACLE = {
    k: oracle(v)
    for k, v in {
        "batched_individuals": """WITH i AS (SELECT id AS ind, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 4) AS BIGINT) + 1 AS b FROM (SELECT DISTINCT id FROM {v_meta_twice}) d),
            r AS (SELECT row_number() OVER (ORDER BY x.b, y.b) AS run, x.b AS batch, y.b AS batch_2 FROM (SELECT DISTINCT b FROM i) x JOIN (SELECT DISTINCT b FROM i) y ON x.b < y.b)
            SELECT run, ind, batch, batch_2 FROM r JOIN i ON i.b = r.batch OR i.b = r.batch_2""",
        "grid_of_pairs": f"""WITH h(host) AS (VALUES {_LIST}), g AS (SELECT t.tree_id, a.host AS host_1, b.host AS host_2 FROM (SELECT DISTINCT tree_id FROM {{v_pairs}}) t CROSS JOIN h a JOIN h b ON a.host < b.host),
            f AS (SELECT g.*, p.ancestry, p.adjacent, p.min_dist / p.norm_const <= 0.04 AS within_distance, p.ancestry IS NULL AS not_present,
                EXISTS (SELECT 1 FROM {{v_hosts}} v WHERE v.tree_id = g.tree_id AND v.host = g.host_1) AS host_1_present, EXISTS (SELECT 1 FROM {{v_hosts}} v WHERE v.tree_id = g.tree_id AND v.host = g.host_2) AS host_2_present
                FROM g LEFT JOIN {{v_pairs}} p ON p.tree_id = g.tree_id AND p.host_1 = g.host_1 AND p.host_2 = g.host_2)
            SELECT tree_id, host_1, host_2, not_present, host_1_present, host_2_present, within_distance, coalesce(bool_or(adjacent AND within_distance) OVER (PARTITION BY host_1, host_2), FALSE) AS any_link,
                CASE WHEN ancestry IN ('anc', 'desc') THEN 'trans' WHEN ancestry IN ('multiAnc', 'multiDesc') THEN 'multiTrans' ELSE ancestry END AS nondir_ancestry, adjacent AND within_distance AS linked FROM f""",
        "recombination_lines": f"""SELECT s.window_id, row_number() OVER (PARTITION BY s.window_id ORDER BY metric DESC NULLS LAST, s.sample) AS line, s.sample, metric
            FROM ({_SAMPLES}) s LEFT JOIN ({_METRICS}) m ON m.window_id = s.window_id AND m.sample = s.sample""",
        "trees_with_read_counts": f"SELECT tree_id, bool_or(label LIKE '%\\_count\\_%' ESCAPE '\\') AS counted FROM ({_LABELS}) x GROUP BY tree_id",
        "names_of_both": """WITH a AS (SELECT DISTINCT 'H' || substr(sample, 2) AS name FROM {v_reads}), b AS (SELECT id AS name FROM {v_meta} WHERE length(name) % 4 > 0),
            c AS (SELECT (SELECT count(*) FROM a WHERE name NOT IN (SELECT name FROM b)) AS only_one, (SELECT count(*) FROM b WHERE name NOT IN (SELECT name FROM a)) AS only_two)
            SELECT only_one = 0 AND only_two = 0 AS same, only_one, only_two FROM c""",
        "statistics_with_proportions": """SELECT tree_id, host, CAST(sum(tips) AS BIGINT) AS tips, count(*) AS subgraphs, round(max(reads) / sum(reads), 9) AS largest, round(min(reads) / sum(reads), 9) AS smallest FROM (
            SELECT tree_id, host, CAST(floor(node / 4) AS BIGINT) AS subgraph, count(*) AS tips, sum(reads) AS reads FROM {v_nodes} WHERE is_tip GROUP BY tree_id, host, CAST(floor(node / 4) AS BIGINT)) x GROUP BY tree_id, host""",
    }.items()
}

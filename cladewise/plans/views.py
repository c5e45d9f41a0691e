"""Deterministic views of the star-schema tables in the engine's data model.

Every recipe is arithmetic in SQL that Spark and DuckDB read alike, so that a query and its oracle start from
the same rows. {name} stands for a table or an earlier view. A few spellings differ; DIALECT has them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DIALECT = {
    "spark": {"day": lambda x: f"datediff(CAST({x} AS DATE), DATE '1992-01-01')", "text": "STRING", "range": lambda a, b: f"(SELECT explode(sequence({a}, {b})) AS i)"},
    "duckdb": {"day": lambda x: f"date_diff('day', DATE '1992-01-01', CAST({x} AS DATE))", "text": "VARCHAR", "range": lambda a, b: f"(SELECT unnest(generate_series({a}, {b})) AS i)"},
}

_LETTERS = " || ".join(f"substr('ACGT', CAST(floor(k / {4**i}) AS BIGINT) % 4 + 1, 1)" for i in range(8))

#: name -> recipe, in an order in which each uses earlier ones only.
VIEWS = {
    # Mapped reads: one sample for each nation; places on a day axis; sequences from few keys, so that they repeat.
    "v_reads": f"""SELECT sample, name, first_pos, last_pos, {_LETTERS} AS seq, q FROM (
        SELECT 'S' || CAST(c_nationkey AS @text) AS sample, CAST(l_orderkey AS @text) || '_' || CAST(l_linenumber AS @text) AS name,
               @day(l_shipdate) AS first_pos, @day(l_shipdate) + CAST(l_quantity AS BIGINT) + 130 AS last_pos,
               l_partkey % 5 * 4097 + l_partkey % 6 AS k, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) + CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS q
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey)""",
    # Windows of 90 days, as far as there are reads.
    "v_windows": "SELECT i AS window_id, 1 + i * 61 AS w_start, 90 + i * 61 AS w_end FROM (SELECT DISTINCT CAST(floor(@day(l_shipdate) / 61) AS BIGINT) AS i FROM {lineitem}) x",
    # Hosts of trees: one tree for each window, present hosts with tips and reads.
    "v_hosts": """SELECT o_orderkey % 40 AS tree_id, 'H' || CAST(c_nationkey AS @text) AS host, count(*) AS tips, CAST(sum(1 + o_custkey % 5) AS BIGINT) AS reads
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_custkey % 3 > 0 GROUP BY o_orderkey % 40, c_nationkey""",
    "v_pairs": """SELECT tree_id, 1 + 25 * tree_id AS w_start, 60 + 25 * tree_id AS w_end, host_1, host_2, m % 3 > 0 AS adjacent, m % 3 > 0 AND m % 2 = 0 AS contiguous,
               m % 4 AS paths12, CAST(floor(m / 4) AS BIGINT) % 3 AS paths21, 1 + m % 5 AS nodes1, 1 + CAST(floor(m / 5) AS BIGINT) % 4 AS nodes2,
               CASE m % 6 WHEN 0 THEN 'noAncestry' WHEN 1 THEN 'anc' WHEN 2 THEN 'desc' WHEN 3 THEN 'multiAnc' WHEN 4 THEN 'multiDesc' ELSE 'complex' END AS ancestry,
               1e-3 * (m % 83) AS min_dist, 1e0 + tree_id % 3 * 5e-1 AS norm_const
        FROM (SELECT a.tree_id, a.host AS host_1, b.host AS host_2, (a.tips * 31 + b.tips * 17 + a.reads * 7 + b.reads * 3 + a.tree_id * 5) AS m
              FROM {v_hosts} a JOIN {v_hosts} b ON a.tree_id = b.tree_id AND a.host < b.host) x
        WHERE m % 11 > 1""",
    # Binary trees of up to 32 tips, numbered as heaps.
    "v_nodes": """SELECT tree_id, node, CASE WHEN node > 1 THEN CAST(floor(node / 2) AS BIGINT) END AS parent, CASE WHEN node > 1 THEN 1e-3 * (1 + (node * 5 + tree_id) % 7) ELSE 0e0 END AS edge_length,
               node > 31 AS is_tip, host, reads FROM (
        SELECT CAST(floor(c_custkey / 32) AS BIGINT) AS tree_id, 32 + c_custkey % 32 AS node, 'H' || CAST(c_nationkey % 5 AS @text) AS host, 1 + c_custkey % 4 AS reads FROM {customer}
        UNION ALL
        SELECT tree_id, CAST(i AS BIGINT), CAST(NULL AS @text), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT CAST(floor(c_custkey / 32) AS BIGINT) AS tree_id FROM {customer}) t CROSS JOIN @range(1, 31) r) n""",
    # The same with a state for each node, as a reconstruction would give one; regions of several nodes occur.
    "v_states": """SELECT *, CASE WHEN is_tip THEN coalesce(host, 'unassigned') WHEN node = 1 OR (node * 7 + tree_id) % 4 = 0 THEN 'unassigned'
        WHEN node > 15 THEN 'H' || CAST((CAST(floor(node / 4) AS BIGINT) + tree_id) % 5 AS @text) ELSE 'H' || CAST((CAST(floor(node / 2) AS BIGINT) + tree_id * 2) % 5 AS @text) END AS state FROM {v_nodes}""",
    # A collapsed tree: the splits of a tree, with the parent of each.
    "v_collapsed": """SELECT tree_id, split, CASE WHEN split > 1 THEN CAST(floor(split / 2) AS BIGINT) END AS parent_split, host, 1e-3 * (1 + split % 9) AS length FROM (
        SELECT CAST(floor(s_suppkey / 8) AS BIGINT) AS tree_id, s_suppkey % 8 + 1 AS split, CASE WHEN s_suppkey % 5 = 0 THEN 'unassigned' ELSE 'H' || CAST(s_nationkey % 4 AS @text) END AS host FROM {supplier}) x""",
    "v_aligned": """SELECT window_id, seq_id, pos, CASE WHEN (k * 13 + pos) % 11 = 0 THEN '-' ELSE substr('ACGT', CAST((k + pos * pos) % 4 AS BIGINT) + 1, 1) END AS base, n FROM (
        SELECT c_custkey % 20 AS window_id, c_custkey AS seq_id, c_custkey * 7 + c_nationkey AS k, 1 + c_nationkey % 4 AS n FROM {customer}) c CROSS JOIN (SELECT CAST(i AS BIGINT) AS pos FROM @range(1, 24)) r""",
    # Some columns of some windows are gaps in every sequence.
    "v_gappy": "SELECT window_id, seq_id, pos, CASE WHEN (pos + window_id) % 7 = 0 THEN '-' ELSE base END AS base, n FROM {v_aligned}",
    "v_norm": "SELECT p_partkey AS pos, p_retailprice / 1000 AS norm_const FROM {part}",
    "v_draws": "SELECT CAST(floor(event_id / 20) AS BIGINT) AS sample, event_id % 20 AS pair_id, ln(1 + abs(value)) AS value FROM {events}",
    "v_dobs": """SELECT a.c_mktsegment AS source, b.c_mktsegment AS recipient, count(*) AS obs FROM {orders} o JOIN {customer} a ON o.o_custkey = a.c_custkey
        JOIN {customer} b ON b.c_custkey = (o.o_orderkey * 7) % 150 + 1 GROUP BY a.c_mktsegment, b.c_mktsegment""",
    # The same by nation: many pairs of categories, of which some are never seen in small tables.
    "v_dobs_nations": """SELECT a.c_nationkey AS source, b.c_nationkey AS recipient, count(*) AS obs FROM {orders} o JOIN {customer} a ON o.o_custkey = a.c_custkey
        JOIN {customer} b ON b.c_custkey = (o.o_orderkey * 7) % 150 + 1 GROUP BY a.c_nationkey, b.c_nationkey""",
    "v_meta": "SELECT 'H' || CAST(n_nationkey AS @text) AS id, n_name AS name, r_name AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    # Hosts with several rows, none of which has the least of every column.
    "v_meta_twice": "SELECT id, name, region FROM {v_meta} UNION ALL SELECT id, 'A' || region, 'Z' || name FROM {v_meta} WHERE length(name) % 2 = 0",
}


#: Recipes of the same rows with Spark's joins in another order: orders meet their customers first, and of lineitem only
#: what a read needs goes to the join by order, so that no row of lineitem is shuffled twice. SQL keeps those in VIEWS.
JOINED = {
    "v_reads": f"""SELECT 'S' || CAST(c_nationkey AS @text) AS sample, CAST(l_orderkey AS @text) || '_' || CAST(l_linenumber AS @text) AS name, first_pos, first_pos + reach AS last_pos, {_LETTERS} AS seq, q FROM (
        SELECT l_orderkey, l_linenumber, @day(l_shipdate) AS first_pos, CAST(l_quantity AS BIGINT) + 130 AS reach, l_partkey % 5 * 4097 + l_partkey % 6 AS k,
               CAST(floor(l_discount * 100 + 0.5) AS BIGINT) + CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS q FROM {{lineitem}})
        JOIN (SELECT o_orderkey, c_nationkey FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey) ON l_orderkey = o_orderkey""",
}


def _spelled(sql: str, dialect: str) -> str:
    d = DIALECT[dialect]
    sql = re.sub(r"@day\(([^)]*)\)", lambda m: d["day"](m[1]), sql)
    sql = re.sub(r"@range\(([^,]*),([^)]*)\)", lambda m: d["range"](m[1].strip(), m[2].strip()), sql)
    return sql.replace("@text", d["text"])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame; only what it needs is read."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spelled(JOINED.get(name, VIEWS[name]), "spark")
    needs = {n: view(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **needs)


def oracle(sql: str) -> str:
    """DuckDB SQL in which {view} names become common table expressions. sql may begin with its own WITH RECURSIVE."""
    ctes: dict[str, str] = {}

    def need(text: str) -> str:
        for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
            if n in VIEWS and n not in ctes:
                body = need(_spelled(VIEWS[n], "duckdb"))
                ctes[n] = body
        return re.sub(r"\{(\w+)\}", r"\1", text)

    sql = need(_spelled(sql.strip(), "duckdb"))
    lead = ", ".join(f"{n} AS ({b})" for n, b in ctes.items())
    m = re.match(r"WITH(\s+RECURSIVE)?\s", sql, re.I)
    if m:
        return f"WITH{m[1] or ''} {lead}{', ' if lead else ''}{sql[m.end():]}"
    return f"WITH {lead} {sql}" if lead else sql

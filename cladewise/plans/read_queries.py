"""Queries of reads, unique sequences and alignments, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import reads as FR
from ..operators import reads as R
from ..operators import trees as T
from ..operators import windows as W
from .relation_queries import rounded
from .views import oracle, view

QUERIES, ORACLE = {}, {}


def add(name, sql, run):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = oracle(sql)


def spans(s, d):
    return W.spanning(view(s, d, "v_reads"), view(s, d, "v_windows"))


def tips(s, d):
    return R.unique_counts(spans(s, d), "window_id", "sample")


def labelled(s, d):
    return R.ranked(tips(s, d), "window_id", "sample").withColumn("n", F.col("n").cast("long"))


def bases(s, d):
    return view(s, d, "v_aligned")


def arrays(s, d):
    """Reads with places and qualities as arrays; some ends are clipped."""
    k = F.col("q")
    at = F.sequence(F.lit(0), F.lit(7))
    return view(s, d, "v_reads").withColumns({
        "positions": F.transform(at, lambda i: F.when((i < k % 3) | (i > 7 - k % 2), F.lit(None)).otherwise((F.col("first_pos") + i).cast("int"))),
        "quals": F.transform(at, lambda i: ((k * 7 + i * 5) % 40).cast("int")),
    })


def templates(reads, by=("line", "first_pos", "last_pos")):
    """Reads named by template: an order's reads by twos, in order of their lines (or of other columns), so that no name has a third read."""
    part = F.split("name", "_")
    columns = [part[1].cast("int") if c == "line" else F.col(c) for c in (*by, "seq", "q")]
    order = Window.partitionBy("sample", part[0]).orderBy(*columns)
    return reads.withColumn("name", F.concat_ws("_", part[0], F.ceil(F.row_number().over(order) / 2).cast("string")))


TIPS = "t AS (SELECT window_id, sample, seq, count(*) AS n FROM {v_reads} JOIN {v_windows} ON first_pos <= w_start AND last_pos >= w_end GROUP BY window_id, sample, seq)"
RANKED = TIPS + ", r AS (SELECT *, row_number() OVER (PARTITION BY window_id, sample ORDER BY n DESC, seq) AS rank FROM t), l AS (SELECT *, sample || '_read_' || CAST(rank AS VARCHAR) || '_count_' || CAST(n AS VARCHAR) AS label FROM r)"
PAIRS = "p AS (SELECT a.window_id, a.seq, a.sample AS sample_1, a.n AS n_1, b.sample AS sample_2, b.n AS n_2 FROM t a JOIN t b ON a.window_id = b.window_id AND a.seq = b.seq AND a.sample < b.sample)"

add("unique_reads", f"WITH {TIPS} SELECT * FROM t", tips)
add("unique_read_names", "SELECT window_id, sample, seq, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM {v_reads} JOIN {v_windows} ON first_pos <= w_start AND last_pos >= w_end GROUP BY window_id, sample, seq",
    lambda s, d: R.unique_counts(spans(s, d), "window_id", "sample", names=True).withColumn("names", F.array_join("names", ",")))
add("ranked_tips", f"WITH {RANKED} SELECT * FROM l WHERE n >= 2", lambda s, d: R.ranked(tips(s, d), "window_id", "sample", min_count=2).withColumn("rank", F.col("rank").cast("long")))
add("tip_labels", f"WITH {RANKED} SELECT label, sample AS host, n AS reads FROM l", lambda s, d: labelled(s, d).select("label", FR.host_of(F.col("label")).alias("host"), FR.reads_of(F.col("label")).alias("reads")))
add("cross_sample_duplicates", f"WITH {TIPS}, {PAIRS} SELECT * FROM p", lambda s, d: R.cross_sample_duplicates(tips(s, d)))
add("contaminants", f"WITH {TIPS}, {PAIRS} SELECT DISTINCT window_id, CASE WHEN n_1 / n_2 >= 2 THEN sample_2 ELSE sample_1 END AS sample, seq FROM p WHERE n_1 / n_2 >= 2 OR n_1 / n_2 <= 0.5",
    lambda s, d: R.contaminants(tips(s, d), 2))
add("without_contaminants", f"WITH {TIPS}, {PAIRS}, c AS (SELECT DISTINCT window_id, CASE WHEN n_1 / n_2 >= 2 THEN sample_2 ELSE sample_1 END AS sample, seq FROM p WHERE n_1 / n_2 >= 2 OR n_1 / n_2 <= 0.5) SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.window_id = t.window_id AND c.sample = t.sample AND c.seq = t.seq)",
    lambda s, d: R.without(tips(s, d), R.contaminants(tips(s, d), 2), "window_id", "sample", "seq"))
add("duplicate_sets", f"WITH {RANKED} SELECT window_id, string_agg(label, ',' ORDER BY label) AS labels, count(*) AS n, count(*) <> count(DISTINCT sample) AS repeated_sample FROM l GROUP BY window_id, seq HAVING count(*) > 1",
    lambda s, d: R.duplicate_sets(labelled(s, d)).withColumn("labels", F.array_join("labels", ",")))
SAMPLES = [f"S{i}" for i in range(25)]  # one for each nation
add("unique_reads_by_window", f"WITH {TIPS} SELECT window_id, " + ", ".join(f"count(*) FILTER (sample = '{x}') AS {x}" for x in SAMPLES) + " FROM t GROUP BY window_id",
    lambda s, d: R.unique_by_window(tips(s, d), SAMPLES, "window_id"))
add("window_width_percentiles", "SELECT width, round(quantile_cont(n, 0.05), 9) AS p5, round(quantile_cont(n, 0.5), 9) AS p50, round(quantile_cont(n, 0.95), 9) AS p95 FROM (SELECT l_linenumber * 10 AS width, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) x GROUP BY width".replace("GROUP BY ALL", "GROUP BY l_linenumber, l_suppkey"),
    lambda s, d: rounded(R.width_percentiles(view(s, d, "lineitem").groupBy((F.col("l_linenumber") * 10).alias("width"), "l_suppkey").agg(F.count("*").alias("n")), [0.05, 0.5, 0.95]), "p5", "p50", "p95"))
_LENGTHS = "SELECT last_pos - first_pos + 1 AS length, count(*) AS n FROM {v_reads} GROUP BY last_pos - first_pos + 1"
add("expected_spanning_reads", f"WITH l AS ({_LENGTHS}), e AS (SELECT width, sum(n * (length + 1 - width) / (2600.0 + 1 - width)) AS expected FROM (SELECT n, length, unnest(generate_series(1, length)) AS width FROM l) x GROUP BY width) SELECT CAST(width AS BIGINT) AS width, round(expected / (SELECT expected FROM e WHERE width = 1), 9) AS expected FROM e",
    lambda s, d: rounded(R.expected_spanning(view(s, d, "v_reads").groupBy((F.col("last_pos") - F.col("first_pos") + 1).alias("length")).agg(F.count("*").alias("n")), 2600, True), "expected").withColumn("width", F.col("width").cast("long")))


def _mates(order: str) -> str:
    """All reads, an order's by twos."""
    return f"SELECT sample, split_part(name, '_', 1) || '_' || CAST((row_number() OVER (PARTITION BY sample, split_part(name, '_', 1) ORDER BY {order}, seq, q) + 1) // 2 AS VARCHAR) AS name, first_pos, last_pos FROM {{v_reads}}"


def _sizes(order: str) -> str:
    return f"""WITH m AS ({_mates(order)}), g AS (SELECT sample, name, count(*) AS k, min(first_pos) AS lo, max(last_pos) AS hi, max(first_pos) AS lo2, min(last_pos) AS hi2 FROM m GROUP BY sample, name)
    SELECT kind, CAST(size AS BIGINT) AS size, count(*) AS n FROM (SELECT 'overlapping' AS kind, hi - lo + 1 AS size FROM g WHERE k = 2 AND lo2 <= hi2 UNION ALL
    SELECT CASE WHEN k = 1 THEN 'orphan' ELSE 'apart' END, last_pos - first_pos + 1 FROM m JOIN g USING (sample, name) WHERE NOT (k = 2 AND lo2 <= hi2)) x GROUP BY kind, size"""


# Neighbours in place are mates here; in template_insert_sizes, neighbours by line.
add("insert_sizes", _sizes("first_pos, last_pos"), lambda s, d: R.insert_sizes(templates(view(s, d, "v_reads"), ("first_pos", "last_pos"))).withColumn("size", F.col("size").cast("long")))
add("template_insert_sizes", _sizes("CAST(split_part(name, '_', 2) AS BIGINT), first_pos, last_pos"), lambda s, d: R.insert_sizes(templates(view(s, d, "v_reads"))).withColumn("size", F.col("size").cast("long")))
add("gap_shares", "SELECT seq_id, round(avg(CASE WHEN base = '-' THEN 1e0 ELSE 0e0 END), 9) AS gaps FROM {v_aligned} GROUP BY seq_id HAVING avg(CASE WHEN base = '-' THEN 1e0 ELSE 0e0 END) <= 0.09",
    lambda s, d: rounded(R.reassembled(bases(s, d), "seq_id").select("seq_id", FR.gap_share(F.col("seq")).alias("gaps")), "gaps").where("gaps <= 0.09"))
add("columns_with_bases", "SELECT window_id, seq_id, pos, base FROM {v_gappy} a WHERE EXISTS (SELECT 1 FROM {v_gappy} b WHERE b.window_id = a.window_id AND b.pos = a.pos AND b.base <> '-')",
    lambda s, d: R.without_gap_columns(view(s, d, "v_gappy")).select("window_id", "seq_id", "pos", "base"))
add("found_sequences", "SELECT name, replace(substr(seq, 3, 10), '-', '') AS seq FROM (SELECT 'Q' || CAST(seq_id AS VARCHAR) AS name, string_agg(base, '' ORDER BY pos) AS seq FROM {v_aligned} GROUP BY seq_id) x WHERE NOT starts_with(name, 'Q1') AND NOT starts_with(name, 'Q23')",
    lambda s, d: R.found_sequences(R.reassembled(bases(s, d), "seq_id").select(F.concat(F.lit("Q"), "seq_id").alias("name"), "seq"), ["Q1", "Q23"], prefix=True, inverted=True, window=(3, 12), gap_strip=True, skip_blanks=True))
# The same without columns that are gaps by design.
add("all_columns_with_bases", "SELECT window_id, seq_id, pos, base FROM {v_aligned} a WHERE EXISTS (SELECT 1 FROM {v_aligned} b WHERE b.window_id = a.window_id AND b.pos = a.pos AND b.base <> '-')",
    lambda s, d: R.without_gap_columns(bases(s, d)).select("window_id", "seq_id", "pos", "base"))
add("excised_positions", "SELECT window_id, seq, CAST(sum(n) AS BIGINT) AS n FROM (SELECT window_id, seq_id, n, string_agg(base, '' ORDER BY pos) AS seq FROM {v_aligned} WHERE pos NOT IN (3, 4, 5, 11) GROUP BY window_id, seq_id, n) x GROUP BY window_id, seq",
    lambda s, d: R.excised(bases(s, d), [3, 4, 5, 11]).withColumn("n", F.col("n").cast("long")))
add("consensus", "SELECT window_id, string_agg(base, '' ORDER BY pos) AS seq, CAST(max(total) AS BIGINT) AS total FROM (SELECT window_id, pos, base, row_number() OVER (PARTITION BY window_id, pos ORDER BY n DESC, base) AS k, sum(n) OVER (PARTITION BY window_id, pos) AS total FROM (SELECT window_id, pos, base, sum(n) AS n FROM {v_aligned} GROUP BY window_id, pos, base) x) y WHERE k = 1 GROUP BY window_id",
    lambda s, d: R.consensus(bases(s, d), "window_id"))
add("alignment_summary", "SELECT window_id, count(*) AS columns, round(sum(share), 9) AS bases, count(*) FILTER (share >= 0.9) AS dense FROM (SELECT window_id, pos, avg(CASE WHEN base <> '-' THEN 1e0 ELSE 0e0 END) AS share FROM {v_aligned} GROUP BY window_id, pos) x GROUP BY window_id",
    lambda s, d: rounded(R.alignment_summary(bases(s, d), 0.9), "bases"))
for _rule, _having in (("majority", "avg(CASE WHEN kept THEN 1 ELSE 0 END) > 0.5"), ("strict", "bool_and(kept)"), ("permissive", "bool_or(kept)")):
    add(f"kept_reads_{_rule}", "SELECT sample, name FROM (SELECT sample, name, (window_id + q) % 3 > 0 AS kept FROM {v_reads} JOIN {v_windows} ON first_pos <= w_start AND last_pos >= w_end) x GROUP BY sample, name HAVING " + _having,
        lambda s, d, rule=_rule: R.kept_reads(spans(s, d).select("sample", "name", ((F.col("window_id") + F.col("q")) % 3 > 0).alias("kept")), rule))
add("reads_not_used_before", """WITH l AS (SELECT window_id, coalesce(w_start <= lag(w_end) OVER (ORDER BY window_id), FALSE) AS linked FROM {v_windows}),
    s AS (SELECT window_id, sample, name, count(*) AS n FROM {v_reads} JOIN {v_windows} ON first_pos <= w_start AND last_pos >= w_end GROUP BY window_id, sample, name),
    g AS (SELECT s.*, l.linked, lag(s.window_id) OVER (PARTITION BY sample, name ORDER BY s.window_id) AS before FROM s JOIN l ON l.window_id = s.window_id),
    r AS (SELECT *, sum(CASE WHEN linked AND window_id - before = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY sample, name ORDER BY window_id) AS run FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY sample, name, run ORDER BY window_id) AS k FROM r)
    SELECT window_id, sample, name FROM k CROSS JOIN LATERAL (SELECT unnest(generate_series(1, n)) AS i) c WHERE k % 2 = 1""",
    lambda s, d: R.not_used_before(spans(s, d).select("window_id", "sample", "name"), view(s, d, "v_windows")))
add("processed_reads", """WITH x AS (SELECT sample, name, seq, list_transform(range(0, 8), lambda i: (q * 7 + i * 5) % 40) AS l FROM {v_reads}),
    y AS (SELECT *, list_min(list_filter(range(0, 8), lambda i: l[i + 1] >= 8)) AS a, list_max(list_filter(range(0, 8), lambda i: l[i + 1] >= 8)) AS z FROM x)
    SELECT sample, name, substr(seq, 3, 4) AS seq, CAST(4 AS INT) AS n FROM y WHERE a <= 2 AND z >= 5 AND len(list_filter(range(a, z + 1), lambda i: l[i + 1] < 4)) < 2""", lambda s, d: R.processed(arrays(s, d), F.col("first_pos") + 2, F.col("first_pos") + 5, trim=8, low=4, recover=True).select("sample", "name", "seq", F.size("positions").alias("n")))
add("merged_mates", None, lambda s, d: R.merged_mates(templates(arrays(s, d)).select("sample", "name", "seq", "positions", "quals")))
add("similar_merged_a", None, lambda s, d: R.similar_merged(T._cut(tips(s, d)), 1, "A"))
add("similar_merged_b", None, lambda s, d: R.similar_merged(T._cut(tips(s, d)), 1, "B"))
add("recombination_metric", None, lambda s, d: R.recombination(R.reassembled(bases(s, d), "window_id", "seq_id"), "window_id"))
add("sequence_classes", f"WITH {TIPS} SELECT window_id, seq, samples, top_n, top_sample, second FROM (SELECT window_id, seq, count(*) AS samples, max(n) AS top_n, arg_max(sample, (n, sample)) AS top_sample, list_sort(list(n), 'DESC')[2] AS second FROM t GROUP BY window_id, seq) x WHERE samples > 1",
    lambda s, d: R.sequence_classes(tips(s, d)).select("window_id", "seq", "samples", F.col("top.n").alias("top_n"), F.col("top.sample").alias("top_sample"), "second"))

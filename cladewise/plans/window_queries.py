"""Queries of windows and coordinates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .relation_queries import rounded
from .views import oracle, view

QUERIES, ORACLE = {}, {}


def add(name, sql, run):
    QUERIES[name], ORACLE[name] = run, oracle(sql)


def _spans(s, d):
    return W.spanning(view(s, d, "v_reads"), view(s, d, "v_windows"))


def stretches(s, d):
    """From the first to the last place of each sample's reads."""
    return view(s, d, "v_reads").groupBy("sample").agg(F.min("first_pos").cast("long").alias("first"), F.max("last_pos").cast("long").alias("last"))


_SPANS = "WITH sp AS (SELECT sample, CAST(min(first_pos) AS BIGINT) AS lo, CAST(max(last_pos) AS BIGINT) AS hi FROM {v_reads} GROUP BY sample)"
add("windows_sliding", f"{_SPANS} SELECT sample, (i - lo) // 200 AS window_id, i AS w_start, i + 299 AS w_end FROM (SELECT sample, lo, unnest(generate_series(lo, hi - 299, 200)) AS i FROM sp) x", lambda s, d: W.sliding_over(stretches(s, d), 300, 100, "sample"))
add("windows_explicit", f"{_SPANS} SELECT sample, k AS window_id, CASE k WHEN 0 THEN 1 ELSE lo + 60 END AS w_start, CASE k WHEN 0 THEN lo + 90 ELSE hi END AS w_end FROM sp, (SELECT unnest([CAST(0 AS BIGINT), 1]) AS k) q",
    lambda s, d: W.explicit_over(stretches(s, d).select("sample", F.array(F.lit(1).cast("long"), F.col("first") + 90, F.col("first") + 60, F.col("last")).alias("bounds")), "sample"))
add("windows_exploratory", f"{_SPANS} SELECT sample, w AS width, i AS w_start, i + w - 1 AS w_end FROM (SELECT sample, w, unnest(generate_series(lo, hi - w + 1, w)) AS i FROM sp, (SELECT unnest([CAST(100 AS BIGINT), 250, 400, 9000]) AS w) q) x",
    lambda s, d: W.exploratory_over(stretches(s, d), [100, 250, 400, 9000], "sample"))
add("windows_increment", f"{_SPANS} SELECT sample, i AS w_start, i + 99 AS w_end FROM (SELECT sample, unnest(generate_series(lo, hi - 99, 10)) AS i FROM sp UNION SELECT sample, hi - 99 FROM sp) x", lambda s, d: W.increment_over(stretches(s, d), 100, None, "sample"))
_SHARES = "SELECT window_id AS aln, pos, avg(CASE WHEN base <> '-' THEN 1e0 ELSE 0e0 END) AS share FROM {v_aligned} GROUP BY window_id, pos"
add("windows_informative", f"""WITH RECURSIVE sh AS ({_SHARES}),
    st AS (SELECT DISTINCT aln, CAST(1 AS BIGINT) AS w_start FROM sh
      UNION ALL SELECT n.aln, greatest(n.w_end - 2, n.w_start + 1) FROM (SELECT st.aln, st.w_start, (SELECT min(pos) FROM (SELECT pos, sum(share) OVER (ORDER BY pos) AS c FROM sh WHERE sh.aln = st.aln AND sh.pos >= st.w_start) q WHERE c >= 6 - 1e-9) AS w_end FROM st) n WHERE n.w_end IS NOT NULL)
    SELECT aln, w_start, CAST(w_end AS BIGINT) AS w_end FROM (SELECT st.aln, st.w_start, (SELECT min(pos) FROM (SELECT pos, sum(share) OVER (ORDER BY pos) AS c FROM sh WHERE sh.aln = st.aln AND sh.pos >= st.w_start) q WHERE c >= 6 - 1e-9) AS w_end FROM st) z WHERE w_end IS NOT NULL""",
    lambda s, d: W.informative_windows(view(s, d, "v_aligned").groupBy(F.col("window_id").alias("aln"), "pos").agg(F.avg((F.col("base") != "-").cast("double")).alias("share")), 6, 2))
add("windows_missing", """WITH p AS (SELECT host_1, host_2, w_start FROM {v_pairs}), k AS (SELECT DISTINCT host_1, host_2 FROM p),
    st AS (SELECT min(g) AS step FROM (SELECT w_start - lag(w_start) OVER (ORDER BY w_start) AS g FROM (SELECT DISTINCT w_start FROM p) q) r), gr AS (SELECT unnest(generate_series((SELECT min(w_start) FROM p), (SELECT max(w_start) FROM p), (SELECT step FROM st))) AS w_start),
    mi AS (SELECT k.host_1, k.host_2, gr.w_start FROM k CROSS JOIN gr WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.host_1 = k.host_1 AND p.host_2 = k.host_2 AND p.w_start = gr.w_start)),
    ru AS (SELECT *, w_start - (SELECT step FROM st) * row_number() OVER (PARTITION BY host_1, host_2 ORDER BY w_start) AS run FROM mi)
    SELECT host_1, host_2, CAST(min(w_start) AS BIGINT) AS gap_start, CAST(max(w_start) AS BIGINT) AS gap_end, count(*) AS n FROM ru GROUP BY host_1, host_2, run""",
    lambda s, d: W.missing_windows(view(s, d, "v_pairs"), ["host_1", "host_2"]))
add("windows_overlap_previous", "SELECT window_id, w_start, w_end, coalesce((lag(w_start) OVER o <= w_start AND w_start <= lag(w_end) OVER o) OR (w_start <= lag(w_start) OVER o AND lag(w_start) OVER o <= w_end), FALSE) AS overlaps FROM {v_windows} WINDOW o AS (ORDER BY window_id)",
    lambda s, d: W.overlaps_previous(view(s, d, "v_windows")))
add("window_names", "SELECT window_id, 'run_' || CAST(w_start AS VARCHAR) || '_to_' || CAST(w_end AS VARCHAR) || '.tree' AS name, w_start AS s, w_end AS e, (w_start + w_end) / 2 AS x FROM {v_windows}",
    lambda s, d: (lambda w: w.select("window_id", "name", *[c.alias(n) for c, n in zip(W.window_of(F.col("name")), "sex")]))(view(s, d, "v_windows").select("window_id", F.concat(F.lit("run_"), F.col("w_start"), F.lit("_to_"), F.col("w_end"), F.lit(".tree")).alias("name"))))
_PLACES = """SELECT seq_id, pos, base, CASE WHEN base <> '-' THEN CAST(n AS DOUBLE) WHEN n = 0 THEN -1 WHEN n = al THEN CAST('nan' AS DOUBLE) ELSE n + 0.5 END AS seq_pos, al FROM
    (SELECT seq_id, pos, base, sum(CASE WHEN base <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS n, sum(CASE WHEN base <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id) AS al FROM {v_aligned}) x"""
add("coordinates_in_sequence", f"SELECT seq_id, pos, CASE WHEN isnan(seq_pos) THEN -2 ELSE seq_pos END AS seq_pos, CAST(CASE WHEN isnan(seq_pos) THEN al ELSE least(greatest(floor(seq_pos), 1), al) END AS BIGINT) AS place FROM ({_PLACES}) y",
    lambda s, d: (lambda a: a.withColumn("al", F.sum((F.col("base") != "-").cast("long")).over(W.Window.partitionBy("seq_id"))).select("seq_id", "pos", F.when(F.isnan("seq_pos"), -2.0).otherwise(F.col("seq_pos")).alias("seq_pos"), W.clamped(F.col("seq_pos"), F.col("al")).cast("long").alias("place")))(W.aligned_places(view(s, d, "v_aligned"))))
add("coordinates_in_alignment", f"SELECT seq_id, CAST(seq_pos AS BIGINT) AS seq_pos, pos FROM ({_PLACES}) y WHERE base <> '-' AND seq_pos IN (1, 2, 3)",
    lambda s, d: W.sequence_to_alignment(view(s, d, "v_aligned"), view(s, d, "v_aligned").select("seq_id").distinct().select("seq_id", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("seq_pos"))))
add("reads_in_windows", "SELECT window_id, sample, count(*) AS n, count(DISTINCT name) AS names, CAST(min(first_pos) AS BIGINT) AS lo, CAST(max(last_pos) AS BIGINT) AS hi FROM {v_reads} JOIN {v_windows} ON first_pos <= w_start AND last_pos >= w_end GROUP BY window_id, sample",
    lambda s, d: _spans(s, d).groupBy("window_id", "sample").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.min("first_pos").cast("long").alias("lo"), F.max("last_pos").cast("long").alias("hi")))
add("window_constants", "SELECT window_id, w_start, w_end, round((SELECT avg(norm_const) FROM {v_norm} n WHERE n.pos BETWEEN w.w_start AND w.w_end), 9) AS norm_const FROM {v_windows} w",
    lambda s, d: rounded(W.window_constants(view(s, d, "v_windows"), view(s, d, "v_norm")), "norm_const").select("window_id", "w_start", "w_end", "norm_const"))
add("position_statistics", "SELECT CAST(pos AS BIGINT) AS pos, round(avg(v), 9) AS v FROM (SELECT unnest(generate_series(w_start, w_end)) AS pos, window_id * 1e0 AS v FROM {v_windows}) x GROUP BY pos",
    lambda s, d: rounded(W.position_statistics(view(s, d, "v_windows").withColumn("v", F.col("window_id").cast("double")), "v"), "v"))
add("constants_standardised", "SELECT pos, round(norm_const / (SELECT avg(norm_const) FROM {v_norm} WHERE pos BETWEEN 50 AND 150), 9) AS norm_const FROM {v_norm}", lambda s, d: rounded(W.standardised(view(s, d, "v_norm"), 50, 150), "norm_const"))

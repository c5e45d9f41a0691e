"""Sources and sinks: tables written in a native format to the shared folder and read back, held against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bam, readers, sinks
from ..sources.folders import new_path
from .views import oracle, view

_TIP = "'T' || CAST(tree_id AS @text) || '_' || CAST(node AS @text)"
#: What the samples' files are called, where one is there for each nation.
_MANIFEST = "SELECT 'bams/' || id || '.bam' AS bam, 'refs/R' || CAST(length(region) AS @text) || '.fasta' AS ref, CASE WHEN length(id) % 2 = 0 THEN 'alias_' || id END AS alias FROM {v_meta}"
#: Reads as alignments: clipped, matched, deleted and matched again, in all 8 bases.
_SAM = """SELECT sample, name, first_pos AS pos, seq, q % 3 AS clip, 2 + q % 2 AS one, 1 + q % 4 AS gap, 6 - q % 3 - q % 2 AS two, q FROM {v_reads}"""
_WINDOW_NAME = "CAST(w_start AS @text) || '_to_' || CAST(w_end AS @text)"


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A recipe over views."""
    import re

    from .views import _spelled

    needs = {n: view(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(_spelled(sql, "spark"), **needs)


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fasta")
    bases = view(spark, sf_dir, "v_aligned").groupBy("window_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("b"))
    named = bases.select("window_id", F.concat(F.lit("W"), "window_id", F.lit("_"), "seq_id").alias("seq_id"), F.array_join("b.base", "").alias("seq"))
    sinks.write_fasta(named, path, "window_id")
    return readers.fasta(spark, f"{path}/*/*.txt").select("seq_id", "seq")


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "manifest")
    _sql(spark, sf_dir, _MANIFEST).write.csv(path)
    return readers.sample_manifest(spark, path)


def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "manifest")
    _sql(spark, sf_dir, "SELECT 'b' || CAST(length(id) + length(name) AS @text) AS bam, CASE WHEN length(name) % 3 > 0 THEN region END AS ref, name AS alias FROM {v_meta}").write.csv(path)
    return readers.manifest_faults(readers.sample_manifest(spark, path)).groupBy("fault", "value").agg(F.count("*").alias("n"))


def names_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "names")
    view(spark, sf_dir, "v_reads").select("name").distinct().select(F.concat(F.lit("  "), "name", F.lit(" ")).alias("value")).write.text(path)
    return readers.names(spark, path)


def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "table")
    hosts = view(spark, sf_dir, "v_hosts")
    sinks.write_table(hosts, path)
    return spark.read.csv(path, header=True, schema=hosts.schema)


def duplicate_sets_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "duplicates")
    tips = _sql(spark, sf_dir, f"SELECT tree_id, host, {_TIP} AS tip FROM {{v_nodes}} WHERE is_tip")
    sinks.write_duplicate_sets(tips.groupBy("tree_id", "host").agg(F.sort_array(F.collect_list("tip")).alias("labels")), path)
    sets = readers.duplicates(spark, path)
    return sets.join(sets.groupBy("set_id").agg(F.count("*").alias("tips")), "set_id").select("tip", "tips")


def user_blacklist_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "blacklist")
    tips = _sql(spark, sf_dir, f"SELECT {_TIP} AS value FROM {{v_nodes}} WHERE is_tip")
    tips.unionByName(tips).write.text(path)
    return readers.user_blacklist(spark, path).select("tip").distinct()


def normalisation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "normalisation")
    view(spark, sf_dir, "v_norm").write.csv(path, header=True)
    return readers.normalisation(spark, path)


def tree_constants_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "constants")
    _sql(spark, sf_dir, "SELECT 't' || CAST(pos AS @text) || '.tree,' || CASE WHEN pos % 5 = 0 THEN 'none' ELSE CAST(pos AS @text) || '.5' END AS value FROM {v_norm}").write.text(path)
    return readers.tree_constants(spark, path)


def recombination_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "recombination")
    _sql(spark, sf_dir, "SELECT 'a/b/' || id || '.bam' AS `Bam file`, length(name) * 25e-2 AS `Recombination metric` FROM {v_meta}").write.csv(path, header=True)
    return readers.recombination(spark, path)


def blacklist_report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "report")
    _sql(spark, sf_dir, f"SELECT tree_id AS `tree.id`, {_TIP} AS tip, reads > 2 AS kept, CASE WHEN reads > 2 THEN 'included' ELSE 'too few' END AS status FROM {{v_nodes}} WHERE is_tip").write.csv(path, header=True)
    return readers.blacklist_report(spark, path)


def read_names_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "reads")
    tips = view(spark, sf_dir, "v_reads").groupBy(F.concat_ws("_", "sample", "seq").alias("label")).agg(F.collect_list("name").alias("names"), F.count("*").alias("n"))
    sinks.write_read_names(tips, path)
    return readers.read_names(spark, path).select("tip", "name")


def tips_with_wrong_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = view(spark, sf_dir, "v_reads").groupBy("sample", "seq").agg(F.collect_list("name").alias("names"), (F.count("*") + F.max("q") % 2).alias("n"))
    return sinks.wrong_counts(tips).select("sample", "seq", "n")


def window_exploration_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "exploration")
    lines = _sql(spark, sf_dir, "SELECT width, w_start, CAST(w_start AS @text) || ', ' || CAST((w_start * 7 + width) % 13 AS @text) || ',' || CAST((w_start + width) % 11 AS @text) AS line FROM {v_windows} CROSS JOIN (SELECT i * 100 AS width FROM @range(1, 3)) r")
    blocks = lines.groupBy("width").agg(F.array_sort(F.collect_list(F.struct("w_start", "line"))).alias("lines"))
    blocks.select(F.concat(F.lit("Width "), "width", F.lit("\n"), F.array_join("lines.line", "\n"), F.lit("\n")).alias("value")).write.text(path)
    return readers.window_exploration(spark, path).select(F.col("width").cast("long"), F.col("w_start").cast("long"), F.col("sample").cast("long"), "n")


def chains_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [new_path(spark, f"chain{k}") for k in range(2)]
    draws = view(spark, sf_dir, "v_draws")
    for k, path in enumerate(paths):
        own = draws.where(F.col("sample") % 2 == k)
        sinks.batches((own.where(F.col("pair_id") % 3 == part) for part in range(3)), path)
    return readers.chains(spark, *paths).select("sample", "pair_id", "value")


def _trees(spark: SparkSession, sf_dir: str, nexus: bool) -> DataFrame:
    path = new_path(spark, "trees")
    nodes = _sql(spark, sf_dir, f"SELECT CAST(tree_id AS @text) AS file, node, parent, edge_length, {_TIP} AS label, CASE WHEN is_tip THEN map('INDIVIDUAL', host) ELSE map() END AS annotations FROM {{v_nodes}}")
    sinks.write_trees(nodes, path, nexus)
    found = readers.trees(spark, path)
    labels = found.select("path", "tree", F.col("node").alias("parent"), F.col("label").alias("parent_label"))
    rows = found.join(labels, ["path", "tree", "parent"], "left")
    return rows.select("label", "parent_label", F.round("edge_length", 9).alias("edge_length"), "is_tip", F.col("annotations")["INDIVIDUAL"].alias("host"))


def newick_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, False)


def nexus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, True)


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample and the columns of SAM text."""
    cigar = F.concat(F.when(F.col("clip") > 0, F.concat("clip", F.lit("S"))).otherwise(F.lit("")), "one", F.lit("M"), "gap", F.lit("D"), "two", F.lit("M"))
    qual = F.when(F.col("q") % 7 == 0, F.lit("*")).otherwise(F.repeat(F.char(F.col("q") + 40), F.lit(8)))
    return _sql(spark, sf_dir, _SAM).select("sample", "name", F.lit(0).alias("flag"), F.lit("r").alias("ref"), "pos", F.lit(60).alias("mapq"), cigar.alias("cigar"), "seq", qual.alias("qual"))


def _sam(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "sam")
    line = F.concat_ws("\t", "name", "flag", "ref", "pos", "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    _alignments(spark, sf_dir).select(line.alias("value")).write.text(path)
    return path


#: The reference of all reads, and its length.
_REFERENCES = [("r", 100_000)]


def _bam(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "bam")
    bam.write(_alignments(spark, sf_dir), path, _REFERENCES)
    return f"{path}/*/*.bam"


def _summed(reads: DataFrame) -> DataFrame:
    placed = F.filter("positions", lambda p: p.isNotNull())
    quality = F.aggregate("quals", F.lit(0).cast("long"), lambda s, q: s + q)
    return reads.select("name", "seq", F.array_min(placed).cast("long").alias("first_pos"), F.array_max(placed).cast("long").alias("last_pos"), F.size(placed).cast("long").alias("placed"), F.size("positions").cast("long").alias("bases"), quality.alias("quality"))


def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(readers.sam(spark, _sam(spark, sf_dir)))


def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(readers.bam(spark, _bam(spark, sf_dir)))


def sam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.sam(spark, _sam(spark, sf_dir), ("r", 900, 1300)).select("name", F.col("pos").cast("long").alias("pos"))


def bam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.bam(spark, _bam(spark, sf_dir), ("r", 900, 1300)).select("name", F.col("pos").cast("long").alias("pos"))


def bam_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the names on a list, written as BAM files of their own and read again."""
    path = new_path(spark, "bam-subset")
    wanted = _sql(spark, sf_dir, "SELECT name FROM {v_reads} WHERE q % 4 = 1")
    bam.write_named(_alignments(spark, sf_dir), wanted, path, _REFERENCES)
    return _summed(readers.bam(spark, f"{path}/*/*.bam"))


def coordinate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = view(spark, sf_dir, "v_aligned").where("base <> '-'").groupBy("pos", F.concat(F.lit("w"), "window_id").alias("sample")).agg(F.min("seq_id").alias("place"))
    return sinks.coordinate_table(coords, [f"w{i}" for i in range(20)])


def named_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "v_reads").select("name", "sample", "seq")
    wanted = _sql(spark, sf_dir, "SELECT CAST(pos AS @text) || '_' || CAST(pos % 6 AS @text) AS name FROM {v_norm}")
    found, missing = sinks.named_reads(reads, wanted)
    return found.select("name", "sample", "seq").unionByName(missing.select("name", F.lit(None).cast("string").alias("sample"), F.lit(None).cast("string").alias("seq")))


def _file_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trees = _sql(spark, sf_dir, f"SELECT 'tree.InWindow_' || {_WINDOW_NAME} || '.tree' AS name FROM {{v_windows}}")
    others = _sql(spark, sf_dir, f"SELECT 'dup_' || {_WINDOW_NAME} || '.csv' AS name FROM {{v_windows}} WHERE window_id % 3 > 0")
    return trees, others


def files_of_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.matched(*_file_names(spark, sf_dir))


def half_matched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda df: df.select(F.regexp_extract("name", r"([0-9]+_to_[0-9]+)", 1).alias("window"))
    trees, others = _file_names(spark, sf_dir)
    both, odd = readers.half_matched(key(trees), key(others), "window")
    return both.select("window", F.lit("both").alias("side")).unionByName(odd.select("window", F.lit("one").alias("side")))


QUERIES = {
    f.__name__: f
    for f in (
        fasta_round_trip, manifest_round_trip, manifest_faults, names_round_trip, table_round_trip, duplicate_sets_round_trip, user_blacklist_round_trip, normalisation_round_trip, tree_constants_round_trip,
        recombination_round_trip, blacklist_report_round_trip, read_names_round_trip, tips_with_wrong_counts, window_exploration_round_trip, chains_round_trip, newick_round_trip, nexus_round_trip, sam_round_trip, sam_region, bam_round_trip, bam_region, bam_subset,
        coordinate_table, named_reads, files_of_trees, half_matched_files,
    )
}

_TREES = f"""SELECT {_TIP} AS label, CASE WHEN parent IS NOT NULL THEN 'T' || CAST(tree_id AS @text) || '_' || CAST(parent AS @text) END AS parent_label,
    round(edge_length, 9) AS edge_length, NOT EXISTS (SELECT 1 FROM {{v_nodes}} c WHERE c.tree_id = n.tree_id AND c.parent = n.node) AS is_tip, host FROM {{v_nodes}} n"""

_SUMMED = f"""SELECT name, seq, pos AS first_pos, pos + one + gap + two - 1 AS last_pos, 8 - clip AS placed, CAST(8 AS BIGINT) AS bases, CASE WHEN q % 7 > 0 THEN 8 * (q + 7) END AS quality FROM ({_SAM}) s"""
_REGION = f"SELECT name, pos FROM ({_SAM}) s WHERE pos <= 1300 AND pos + one + gap + two - 1 >= 900"

ORACLE = {
    k: oracle(v)
    for k, v in {
        "fasta_round_trip": "SELECT 'W' || CAST(window_id AS @text) || '_' || CAST(seq_id AS @text) AS seq_id, string_agg(base, '' ORDER BY pos) AS seq FROM {v_aligned} GROUP BY window_id, seq_id",
        "manifest_round_trip": f"SELECT bam, ref, coalesce(alias, substr(bam, 6, length(bam) - 9)) AS alias FROM ({_MANIFEST}) m",
        "manifest_faults": """WITH m AS (SELECT 'b' || CAST(length(id) + length(name) AS @text) AS bam, CASE WHEN length(name) % 3 > 0 THEN region END AS ref, name AS alias FROM {v_meta})
            SELECT fault, value, count(*) AS n FROM (
                SELECT 'alias twice' AS fault, alias AS value FROM m GROUP BY alias HAVING count(*) > 1 UNION ALL SELECT 'file twice', bam FROM m GROUP BY bam HAVING count(*) > 1
                UNION ALL SELECT 'white space', alias FROM m WHERE alias LIKE '% %' UNION ALL SELECT 'missing column', bam FROM m WHERE ref IS NULL) f GROUP BY fault, value""",
        "names_round_trip": "SELECT DISTINCT name FROM {v_reads}",
        "table_round_trip": "SELECT * FROM {v_hosts}",
        "duplicate_sets_round_trip": f"SELECT {_TIP} AS tip, count(*) OVER (PARTITION BY tree_id, host) AS tips FROM {{v_nodes}} WHERE is_tip",
        "user_blacklist_round_trip": f"SELECT {_TIP} AS tip FROM {{v_nodes}} WHERE is_tip",
        "normalisation_round_trip": "SELECT pos, norm_const FROM {v_norm}",
        "tree_constants_round_trip": "SELECT 't' || CAST(pos AS @text) || '.tree' AS file, CASE WHEN pos % 5 = 0 THEN 1e0 ELSE pos + 5e-1 END AS constant FROM {v_norm}",
        "recombination_round_trip": "SELECT id || '.bam' AS sample, length(name) * 25e-2 AS metric FROM {v_meta}",
        "blacklist_report_round_trip": f"SELECT CAST(tree_id AS @text) AS tree_id, {_TIP} AS tip, reads > 2 AS kept, CASE WHEN reads > 2 THEN 'included' ELSE 'too few' END AS status FROM {{v_nodes}} WHERE is_tip",
        "read_names_round_trip": "SELECT sample || '_' || seq AS tip, name FROM {v_reads}",
        "tips_with_wrong_counts": "SELECT sample, seq, count(*) + max(q) % 2 AS n FROM {v_reads} GROUP BY sample, seq HAVING max(q) % 2 <> 0",
        "window_exploration_round_trip": """SELECT width, w_start, sample, CASE WHEN sample = 0 THEN (w_start * 7 + width) % 13 ELSE (w_start + width) % 11 END AS n
            FROM {v_windows} CROSS JOIN (SELECT CAST(i * 100 AS BIGINT) AS width FROM @range(1, 3)) r CROSS JOIN (SELECT CAST(i AS BIGINT) AS sample FROM @range(0, 1)) s""",
        "chains_round_trip": "SELECT sample, pair_id, value FROM {v_draws}",
        "newick_round_trip": _TREES,
        "nexus_round_trip": _TREES,
        "sam_round_trip": _SUMMED,
        "bam_round_trip": _SUMMED,
        "bam_subset": f"{_SUMMED} WHERE name IN (SELECT name FROM {{v_reads}} WHERE q % 4 = 1)",
        "sam_region": _REGION,
        "bam_region": _REGION,
        "coordinate_table": "SELECT pos, " + ", ".join(f"min(CASE WHEN window_id = {i} THEN seq_id END) AS w{i}" for i in range(20)) + " FROM {v_aligned} WHERE base <> '-' GROUP BY pos",
        "named_reads": """WITH w AS (SELECT DISTINCT CAST(pos AS @text) || '_' || CAST(pos % 6 AS @text) AS name FROM {v_norm}) SELECT w.name, r.sample, r.seq FROM w LEFT JOIN {v_reads} r ON r.name = w.name""",
        "files_of_trees": f"""SELECT 'tree.InWindow_' || {_WINDOW_NAME} || '.tree' AS tree, CASE WHEN window_id % 3 > 0 THEN 'dup_' || {_WINDOW_NAME} || '.csv' END AS other FROM {{v_windows}}""",
        "half_matched_files": f"SELECT {_WINDOW_NAME} AS \"window\", CASE WHEN window_id % 3 > 0 THEN 'both' ELSE 'one' END AS side FROM {{v_windows}}",
    }.items()
}

"""Native formats as DataFrames. Every reader takes a path that Spark can list; files are read by Spark only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bam as bam_files


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))


def files(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """Names of files that match: path, name."""
    found = spark.read.format("binaryFile").load(path).select("path")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").rlike(pattern))


def sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    """bam, ref, alias. The alias is the file's base name unless a third column has it."""
    rows = spark.read.csv(path, schema="bam string, ref string, alias string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    base = F.regexp_replace(F.element_at(F.split("bam", "/"), -1), r"\.[^.]*$", "")
    return rows.withColumn("alias", F.coalesce("alias", base))


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """What is wrong with a manifest: fault, value. Names are unique and hold no white space; all rows have the same columns."""
    twice = lambda c, what: manifest.groupBy(F.col(c).alias("value")).count().where("count > 1").select(F.lit(what).alias("fault"), "value")
    blank = manifest.where(F.col("alias").rlike(r"\s")).select(F.lit("white space").alias("fault"), F.col("alias").alias("value"))
    empty = manifest.where("bam is null or ref is null").select(F.lit("missing column").alias("fault"), F.coalesce("bam", "ref").alias("value"))
    return twice("alias", "alias twice").unionByName(twice("bam", "file twice")).unionByName(blank).unionByName(empty)


def names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines are skipped. A name that comes twice is an error when the rows are read, and so is a list without names at once."""
    rows = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    if not rows.limit(1).count():
        raise ValueError(f"{path} has no names")
    twice = F.raise_error(F.concat(F.lit("more than once in the list of names: "), "name"))
    return rows.groupBy("name").agg(F.count("*").alias("n")).select(F.when(F.col("n") > 1, twice.cast("string")).otherwise(F.col("name")).alias("name"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, seq_id, seq; a file's records are split as a whole text, so lines may be wrapped."""
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    rows = whole.select("file", F.explode(F.split("value", r"(^|\n)>")).alias("r")).where("trim(r) <> ''")
    head = F.split("r", r"\r?\n", 2)
    return rows.select("file", F.element_at(F.split(F.element_at(head, 1), r"\s"), 1).alias("seq_id"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at(head, F.lit(2)), F.lit("")), r"\s", "")).alias("seq"))


def alignment_columns(sequences: DataFrame) -> DataFrame:
    """One row for each base: file, seq_id, pos from 1, base."""
    return sequences.select("file", "seq_id", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''").withColumn("pos", F.col("pos") + 1)


def unequal_lengths(sequences: DataFrame) -> DataFrame:
    """Alignments whose sequences differ in length."""
    return sequences.groupBy("file").agg(F.countDistinct(F.length("seq")).alias("lengths")).where("lengths > 1")


def sam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """SAM text: sample (file), name, flag, ref, pos, mapq, cigar, seq, quals, positions (null where a base has no place).

    A region keeps the reads that overlap it; secondary text columns are never parsed.
    """
    rows = _lines(spark, path).where(~F.col("value").startswith("@"))
    c = F.split("value", "\t")
    rows = rows.select("file", c[0].alias("name"), c[1].cast("int").alias("flag"), c[2].alias("ref"), c[3].cast("int").alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), c[9].alias("seq"), c[10].alias("qual"))
    return _placed(rows, region)


def _placed(rows: DataFrame, region: tuple[str, int, int] | None) -> DataFrame:
    """Reads in the columns of SAM text with a place for each base; those that overlap the region, if there is one."""
    parts = F.regexp_extract_all("cigar", F.lit(r"([0-9]+[MIDNSHP=X])"))
    step = F.transform(parts, lambda p: F.struct(F.substr(p, F.lit(1), F.length(p) - 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))
    none = F.array().cast("array<int>")

    def walk(state, p):
        moved = F.sequence(state["at"], state["at"] + p["n"] - 1)
        out = F.when(p["op"].isin("M", "=", "X"), F.concat(state["out"], moved)).when(p["op"].isin("I", "S"), F.concat(state["out"], F.array_repeat(F.lit(None).cast("int"), p["n"]))).otherwise(state["out"])
        return F.struct((state["at"] + F.when(p["op"].isin("M", "=", "X", "D", "N"), p["n"]).otherwise(0)).alias("at"), out.alias("out"))

    walked = F.aggregate(step, F.struct(F.col("pos").alias("at"), none.alias("out")), walk)
    quals = F.when(F.col("qual") == "*", F.lit(None)).otherwise(F.transform(F.filter(F.split("qual", ""), lambda q: q != ""), lambda q: F.ascii(q) - 33))
    rows = rows.withColumns({"positions": walked["out"], "last": walked["at"] - 1, "quals": quals})
    if region is not None:
        ref, left, right = region
        rows = rows.where((F.col("ref") == ref) & (F.col("pos") <= right) & (F.col("last") >= left))
    return rows.drop("qual", "last").withColumnRenamed("file", "sample")


def bam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """BAM files, with the columns of sam; a file is read by as many tasks as it has splits, and needs no index.

    Reads right of the region go before they are decoded.
    """
    return _placed(bam_files.records(spark, path, None if region is None else region[2]), region)


#: Nodes of trees that are given out together.
ROWS = 10_000
_TOKEN = re.compile(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+")


Nodes = list[tuple[int, int | None, float | None, str | None, dict[str, str]]]


def _newicks(text: str, at_most: int | None = None) -> Iterator[Nodes]:
    """The trees of a text, each up to its semicolon; the last may lack it."""
    out: list[list] = [[0, None, None, None, {}]]
    at, stack, length_next, read = 0, [], False, False
    for found in _TOKEN.finditer(text):
        token = found[0]
        if token == ";":
            yield [tuple(x) for x in out]
            at_most = at_most and at_most - 1
            if at_most == 0:
                return
            out, at, stack, length_next, read = [[0, None, None, None, {}]], 0, [], False, False
            continue
        read = True
        if token == "(":
            stack.append(at)
            out.append([len(out), at, None, None, {}])
            at = len(out) - 1
        elif token == ",":
            out.append([len(out), stack[-1], None, None, {}])
            at = len(out) - 1
        elif token == ")":
            at = stack.pop()
        elif token == ":":
            length_next = True
            continue
        elif token[0] == "[":
            if token.startswith("[&"):
                out[at][4].update((k.strip(), v.strip().strip('"')) for k, _, v in (x.partition("=") for x in token[2:-1].split(",")))
            continue
        elif length_next:
            out[at][2] = float(token)
        else:
            out[at][3] = token[1:-1].replace("''", "'") if token[0] == "'" else token
        length_next = False
    if read:
        yield [tuple(x) for x in out]


def parse_trees(text: str) -> Iterator[Nodes]:
    """All trees of a newick or NEXUS file: node, parent, length, label and [&key=value] annotations of each node; a root is 0."""
    if text.lstrip()[:6].upper() != "#NEXUS":
        yield from _newicks(text)
        return
    table = dict(re.findall(r"(?m)^\s*(\d+)\s+'?([^\s,']+)'?,?\s*$", m[1])) if (m := re.search(r"(?is)translate(.*?);", text)) else {}
    heads = list(re.finditer(r"(?im)^\s*u?tree\s(?:'(?:[^']|'')*'|[^='])*=\s*(?:\[&[RU]\])?", text))
    for head, after in zip(heads, [*heads[1:], None]):
        for nodes in _newicks(text[head.end() : after.start() if after else None], 1):
            yield [(n, p, x, table.get(label, label) if label else label, a) for n, p, x, label, a in nodes] if table else nodes


def parse_newick(text: str) -> Nodes:
    """The first tree of a text."""
    return next(parse_trees(text), [(0, None, None, None, {})])


def trees(spark: SparkSession, path: str) -> DataFrame:
    """file, node, parent, edge_length, is_tip, label, annotations, path, tree (from 0, in the order of the file); newick or NEXUS, any number of trees a file. Files in different folders may share a name, never a path. A task holds one file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, path, text in zip(batch["file"], batch["path"], batch["value"]):
                rows: list[tuple] = []
                for tree, nodes in enumerate(parse_trees(text)):
                    parents = {p for _, p, _, _, _ in nodes}
                    rows += [(name, n, p, x, n not in parents, label, a, path, tree) for n, p, x, label, a in nodes]
                    if len(rows) >= ROWS:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "node", "parent", "edge_length", "is_tip", "label", "annotations", "path", "tree"]).astype({"parent": "Int64"})

    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
    return whole.mapInPandas(run, "file string, node long, parent long, edge_length double, is_tip boolean, label string, annotations map<string,string>, path string, tree long")


def matched(trees_: DataFrame, others: DataFrame) -> DataFrame:
    """Files of trees and of another kind by the window in their names: tree, other (null: none)."""
    key = lambda df, n: df.select(F.col("name").alias(n), F.regexp_extract("name", r"([0-9]+_to_[0-9]+)", 1).alias("k"))
    return key(trees_, "tree").join(key(others, "other"), "k", "left").drop("k")


def duplicates(spark: SparkSession, path: str) -> DataFrame:
    """Ragged lines of tip names: file, set_id, tip."""
    rows = _lines(spark, path).where("trim(value) <> ''")
    return rows.select("file", F.xxhash64("file", "value").alias("set_id"), F.explode(F.split("value", r"\s*,\s*")).alias("tip")).where("tip <> ''")


def user_blacklist(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select("file", F.trim("value").alias("tip")).where("tip <> ''").distinct()


def normalisation(spark: SparkSession, path: str) -> DataFrame:
    """pos, norm_const: two numeric columns with a header."""
    return spark.read.csv(path, header=True, schema="pos long, norm_const double")


def tree_constants(spark: SparkSession, path: str) -> DataFrame:
    """file, constant: of several lines of a file the first counts; what is no number is 1."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> ''")
    number = F.expr("try_cast(trim(get(split(value, ','), 1)) AS double)")
    rows = rows.select("line", F.trim(F.split("value", ",")[0]).alias("file"), F.coalesce(number, F.lit(1.0)).alias("constant"))
    return rows.groupBy("file").agg(F.min_by("constant", "line").alias("constant"))


def recombination(spark: SparkSession, path: str) -> DataFrame:
    """file, sample, metric."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.element_at(F.split("`Bam file`", "/"), -1).alias("sample"), F.col("`Recombination metric`").cast("double").alias("metric"))


def blacklist_report(spark: SparkSession, path: str) -> DataFrame:
    """tree_id, tip, kept, status."""
    rows = spark.read.csv(path, header=True).toDF("tree_id", "tip", "kept", "status")
    return rows.withColumn("kept", F.upper("kept") == "TRUE")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a tip and its reads: file, tip, name.

    A line is split before its names become rows: beside explode, the tip would be split off the whole line once for each name.
    """
    lines = _lines(spark, path).where("trim(value) <> ''").select("file", F.split("value", r"\s*,\s*").alias("parts"))
    tips = lines.select("file", F.col("parts")[0].alias("tip"), F.slice("parts", 2, F.size("parts")).alias("names"))
    return tips.select("file", "tip", F.explode("names").alias("name"))


def window_exploration(spark: SparkSession, path: str) -> DataFrame:
    """Blocks under a title line with the width, of lines "start, n, n, ...": width, w_start, sample (number of the column), n."""
    rows = _lines(spark, path).withColumn("line", F.monotonically_increasing_id())
    title = F.when(~F.col("value").rlike(r"^\s*[0-9]+\s*,"), F.nullif(F.regexp_extract("value", r"([0-9]+)", 1), F.lit("")).cast("int"))
    rows = rows.withColumn("width", F.last(title, ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))).where(F.col("value").rlike(r"^\s*[0-9]+\s*,"))
    return rows.select("width", F.trim(F.split("value", ",")[0]).cast("int").alias("w_start"), F.posexplode(F.slice(F.split("value", r"\s*,\s*"), 2, 1 << 20)).alias("sample", "n")).withColumn("n", F.col("n").cast("long"))


def chains(spark: SparkSession, *paths: str) -> DataFrame:
    """Saved draws of several chains, by column name."""
    out = None
    for p in paths:
        one = spark.read.parquet(p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def half_matched(a: DataFrame, b: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows that both sides have, and the keys that only one has."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return a.join(b, list(keys)), left.join(right, list(keys), "left_anti").unionByName(right.join(left, list(keys), "left_anti"))

"""Results in their native formats; Spark's committers write all files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees of a file.
TREES = 500


def write_fasta(sequences: DataFrame, path: str, *by: str) -> None:
    """seq_id and seq as records, in folders by the given columns."""
    rows = sequences.select(*by, F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), F.col("seq")).alias("value"))
    (rows.write.partitionBy(*by) if by else rows.write).text(path)


def write_table(rows: DataFrame, path: str, csv: bool = True) -> None:
    rows.write.csv(path, header=True) if csv else rows.write.parquet(path)


def write_duplicate_sets(sets: DataFrame, path: str) -> None:
    """Lines of tip names, from arrays."""
    sets.select(F.array_join("labels", ",").alias("value")).write.text(path)


def write_read_names(tips: DataFrame, path: str) -> None:
    """A tip and its reads in a line, compressed."""
    tips.select(F.concat_ws(",", F.col("label"), F.array_join("names", ",")).alias("value")).write.option("compression", "gzip").text(path)


def wrong_counts(tips: DataFrame) -> DataFrame:
    """Tips whose number of names isn't their count."""
    return tips.where(F.size("names") != F.col("n"))


def coordinate_table(coords: DataFrame, samples: list[str]) -> DataFrame:
    """One row for each place of the alignment, one column for each sample."""
    return coords.groupBy("pos").pivot("sample", samples).agg(F.first("place"))


def named_reads(reads: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads with the wanted names, and the names that no read has."""
    return reads.join(wanted.select("name").distinct(), "name", "left_semi"), wanted.select("name").join(reads, "name", "left_anti").distinct()


def _quoted(label: str | None) -> str:
    if not label:
        return ""
    return "'" + label.replace("'", "''") + "'" if any(c in " (),:;[]'" for c in label) else label


def to_newick(nodes: list[tuple]) -> str:
    """node, parent, length, label, annotations -> newick with [&key=value] comments; children in order of their numbers."""
    children: dict = {}
    own = {}
    for node, parent, length, label, notes in nodes:
        own[node] = (length, label, notes or {})
        children.setdefault(parent, []).append(node)
    out: list[str] = []
    stack: list = [("in", r) for r in reversed(sorted(children.get(None, [])))]
    while stack:
        kind, x = stack.pop()
        if kind == "text":
            out.append(x)
            continue
        length, label, notes = own[x]
        tail = _quoted(label) + ("[&" + ",".join(f"{k}={v}" for k, v in sorted(notes.items())) + "]" if notes else "") + (f":{length:.10g}" if length is not None and length == length else "")
        kids = sorted(children.get(x, []))
        if not kids:
            out.append(tail)
            continue
        out.append("(")
        stack.append(("text", ")" + tail))
        for i, c in enumerate(reversed(kids)):
            stack.append(("in", c))
            if i < len(kids) - 1:
                stack.append(("text", ","))
    return "".join(out) + ";"


def annotated_trees(nodes: DataFrame, nexus: bool = False) -> DataFrame:
    """file and text of each tree. nodes: file, node, parent, edge_length, label, annotations (map)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = [(r.node, None if pd.isna(r.parent) else r.parent, r.edge_length, r.label, dict(r.annotations) if r.annotations is not None else {}) for r in rows.itertuples()]
        text = to_newick(own)
        if nexus:
            text = f"#NEXUS\nBEGIN TREES;\n\ttree TREE1 = [&R] {text}\nEND;\n"
        return pd.DataFrame([[rows["file"].iloc[0], text]], columns=["file", "text"])

    return nodes.select("file", "node", "parent", "edge_length", "label", "annotations").groupBy("file").applyInPandas(run, "file string, text string")


def write_trees(nodes: DataFrame, path: str, nexus: bool = False, most: int = TREES) -> None:
    """Files of up to so many trees each: newick by line, or NEXUS with one block of trees. nodes: file (the tree's name), node, parent, edge_length, label, annotations (map)."""

    def document(found: list[tuple[str, str]]) -> str:
        if not nexus:
            return "\n".join(text for _, text in found) + "\n"
        names = ("'" + name.replace("'", "''") + "'" if re.search(r"[^\w.]", name) else name for name, _ in found)
        return "#NEXUS\nBEGIN TREES;\n" + "".join(f"\ttree {name} = [&R] {text}\n" for name, (_, text) in zip(names, found)) + "END;\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, found = None, [], []
        for batch in batches:
            for name, *node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and name != at:
                    found.append((at, to_newick(own)))
                    own = []
                    if len(found) == most:
                        yield pa.RecordBatch.from_arrays([pa.array([document(found)])], names=["text"])
                        found = []
                at = name
                own.append((*node[:-1], dict(node[-1] or ())))
        if own:
            found.append((at, to_newick(own)))
            yield pa.RecordBatch.from_arrays([pa.array([document(found)])], names=["text"])

    rows = nodes.select("file", "node", "parent", "edge_length", "label", "annotations").repartition("file").sortWithinPartitions("file")
    rows.mapInArrow(run, "text string").write.option("maxRecordsPerFile", 1).text(path)


def batches(frames: Iterator[DataFrame], path: str) -> None:
    """Appends groups of sweeps as they come."""
    for f in frames:
        f.write.mode("append").parquet(path)

"""Alignment of two tokenizers' tokens, segment by segment: each distinct segment is tokenised and aligned once.

A is a byte-level vocabulary of the tokenizers library, which gets a blank and the text; B is a sentencepiece model,
which adds that blank itself. Texts are cut before white space (segments.py) after a look at B's pieces: if one
could reach across such a place, each text is one segment.

Blocks of documents hold numbers of segments, the commonest first, and a dictionary of their own, so what is
shuffled by segment is a row for each entry of a block's dictionary, not for each occurrence. Where entries of one
segment meet, it is tokenised and aligned, once for a chunk of CHUNK entries. Links are counted over the corpus
by pairs of ids; then each chunk scores its segments and sends its entries back to their blocks, which compose
their documents.

Groups lie between byte offsets at which tokens of both sides end. A link is a pair of tokens whose bytes overlap.

Defined results: null and empty texts, and texts that B's normaliser or its blank sign changes, have no tokens: all
numbers are 0 and `groups` is empty; repeated rows each count; null ids stay null; very long texts are blocks of their
own; an empty table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import segments
from .common import chunks, cut_small, staged, text_bytes

#: Bytes of text of a block, apart from its last document.
BLOCK = 16 << 20
#: Entries of dictionaries whose segments are aligned together.
CHUNK = 100_000
#: Pairs of ids whose counts (three numbers each) may be sent to all tasks; beyond, each chunk gets its own by a join.
BROADCAST = 2_000_000
_SIGN = "▁"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class SideA:
    """Ids by the tokenizers library, and each id's bytes."""

    def __init__(self, path: str) -> None:
        self.tokenizer, values = segments.library(path, True), byte_values()
        found = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(found.values()) + 1)
        for token, i in found.items():
            self.bytes[i] = bytes(values[c] for c in token) if all(c in values for c in token) else token.encode()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class SideB:
    """Ids by sentencepiece of segments that begin with a blank or a line feed, and each id's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        byte = [self.model.is_byte(i) for i in range(len(pieces))]
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace(_SIGN, " ").encode() for p, b in zip(pieces, byte, strict=True)]
        self.blank = self.model.piece_to_id(_SIGN)
        if sum(byte) != 256 or pieces[self.blank] != _SIGN:
            raise ValueError("the model has no byte fallback or no piece for a blank")
        normal = [p for p, b in zip(pieces, byte, strict=True) if not b]
        #: No piece goes on from other text into a blank, and none has a line feed.
        self.apart = not any("\n" in p or any(c == _SIGN and not (before == _SIGN or before.isspace()) for before, c in zip(p, p[1:])) for p in normal)

    def _own(self, part: str) -> str:
        """What the model, which puts a blank first, is given for a segment."""
        return part[1:] if part[0] == " " else part

    def encode(self, parts: list[str]) -> list[list[int]]:
        out = self.model.encode([self._own(p) for p in parts], num_threads=1)
        # Before a line feed the added blank is a piece of its own, and goes; a blank alone is nothing to the model.
        return [[self.blank] if p == " " else ids if p[0] == " " else ids[1:] for p, ids in zip(parts, out, strict=True)]

    def keeps(self, text: str) -> bool:
        """Whether the pieces of the text have its bytes: the normaliser only marks blanks, and the mark isn't in the text itself."""
        return _SIGN not in text and self.model.normalize(text) == _SIGN + text.replace(" ", _SIGN)


@lru_cache(maxsize=2)
def side_a(path: str) -> SideA:
    return SideA(path)


@lru_cache(maxsize=2)
def side_b(path: str) -> SideB:
    return SideB(path)


def unchanged(texts: pa.Array, b: SideB) -> pa.Array:
    """The texts, with null for those that B changes. All are looked at together first."""
    whole = pc.binary_join(pa.array([texts.fill_null("").to_pylist()]), "\n")[0].as_py() if len(texts) else ""
    if b.keeps(whole) if whole else True:
        return texts
    return pa.array([t if t and b.keeps(t) else None for t in texts.to_pylist()], pa.string())


def _packed(*arrays: np.ndarray, text: str = "") -> bytes:
    """Arrays of one length and a text, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join([a.tobytes() for a in arrays]) + text.encode())


def _unpacked(data: bytes, n: int, *kinds: str) -> tuple[list[np.ndarray], str]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, raw[at:].decode()


def _row(**columns) -> pa.RecordBatch:
    """One row; arrays become lists."""
    made = [pa.array([v]) if isinstance(v, int | bytes) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in columns.values()]
    return pa.RecordBatch.from_arrays(made, names=list(columns))


def _blocks(path_b: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, part, n = side_b(path_b), TaskContext.get().partitionId(), 0
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            _, offsets = text_bytes(texts)
            for first, stop in chunks(offsets, block):
                found, per_row = segments.split(unchanged(texts.slice(first, stop - first), b), lead=" ", whole=not b.apart)
                own, distinct = segments.numbered(found)
                counts = np.bincount(own, minlength=len(distinct))
                order = np.argsort(-counts, kind="stable")
                rank = np.empty(len(order), "<i4")
                rank[order] = np.arange(len(order))
                # By byte planes: frequent segments have small numbers.
                planes = np.ascontiguousarray(rank[own].view(np.uint8).reshape(-1, 4).T)
                yield _row(block=(part << 32) + n, ids=names.slice(first, stop - first), sizes=per_row.astype(np.int64), n=len(own), numbers=_packed(planes), segments=distinct.take(pa.array(order)).cast(pa.string()), counts=counts[order].astype(np.int64))
                n += 1

    return run


def aligned(parts: list[str], a: SideA, b: SideB) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Of segments: the groups as text, (n_a, n_b, n_groups, n_links) as rows, and links as a * 2**32 + b."""
    if not parts:
        return [], np.zeros((4, 0), np.int64), []
    sides, raw = [], "".join(parts).encode()
    upto = np.cumsum([len(p.encode()) for p in parts])
    for side in (a, b):
        ids = [i for own in side.encode(parts) for i in own]
        if b"".join([side.bytes[i] for i in ids]) != raw:
            raise ValueError("tokens that do not have the bytes of their text")
        sides.append((ids, np.cumsum([len(side.bytes[i]) for i in ids])))
    (ids_a, ends_a), (ids_b, ends_b) = sides
    both, either = np.intersect1d(ends_a, ends_b, assume_unique=True), np.union1d(ends_a, ends_b)
    if not np.isin(upto, both, assume_unique=True).all():
        raise ValueError("a token reaches across segments")
    links = (np.array(ids_a, np.int64)[np.searchsorted(ends_a, either)] << 32) + np.array(ids_b, np.int64)[np.searchsorted(ends_b, either)]
    per_part = [np.searchsorted(ends, upto, side="right") for ends in (ends_a, ends_b, both, either)]
    text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
    edge_a, edge_b = ([0, *(np.searchsorted(ends, both) + 1).tolist()] for ends in (ends_a, ends_b))
    groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(edge_a, edge_a[1:], edge_b, edge_b[1:])]
    at = [0, *per_part[2].tolist()]
    joined = [";".join(groups[i:j]) for i, j in zip(at, at[1:])]
    return joined, np.stack([np.diff(p, prepend=0) for p in per_part]), np.split(links, per_part[3][:-1])


_COLUMNS = {"chunk": "long", "groups": "array<string>", "sizes": "array<long>", "links": "array<long>", "entry_segment": "array<long>", "entry_block": "array<long>", "entry_number": "array<long>", "pairs": "array<long>", "pair_counts": "array<long>"}
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_KINDS = ["<i4", *["<i8"] * len(_NUMBERS)]


def _aligned_chunk(chunk: int, rows: pa.Table, a: SideA, b: SideB) -> pa.RecordBatch:
    """The segments of some entries (segment, block, number, n), aligned: see _COLUMNS. sizes: n_a, n_b, n_groups and n_links of all segments, one after the other."""
    own, distinct = segments.numbered(rows.column("segment").combine_chunks())
    groups, sizes, links = aligned(distinct.to_pylist(), a, b)
    times = np.bincount(own, weights=rows.column("n").to_numpy(), minlength=len(groups)).astype(np.int64)
    flat = np.concatenate(links)
    pairs, place = np.unique(flat, return_inverse=True)
    counts = np.bincount(place, weights=np.repeat(times, sizes[3])).astype(np.int64)
    return _row(chunk=chunk, groups=pa.array(groups, pa.string()), sizes=sizes.reshape(-1).astype(np.int64), links=flat, entry_segment=own, entry_block=rows.column("block").combine_chunks(), entry_number=rows.column("number").combine_chunks(), pairs=pairs, pair_counts=counts)


def _align(path_a: str, path_b: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, part, n, held = side_a(path_a), side_b(path_b), TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= chunk:
                yield _aligned_chunk((part << 32) + n, pa.Table.from_batches(held), a, b)
                n, held = n + 1, []
        if sum(x.num_rows for x in held):
            yield _aligned_chunk((part << 32) + n, pa.Table.from_batches(held), a, b)

    return run


def _sent_back(row: dict[str, pa.Array], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Of one chunk: block, n, and n entries of it with their results. pairs are in order and hold all of the chunk's."""
    sizes = row["sizes"].to_numpy().reshape(4, -1)
    place = np.searchsorted(pairs, row["links"].to_numpy())
    ends = np.concatenate([[0], np.cumsum(sizes[3])])
    results = [*sizes, *(np.diff(np.concatenate([[0], np.cumsum(x[place])])[ends]) for x in (best, counts))]
    of, blocks, numbers = (row[c].to_numpy() for c in ("entry_segment", "entry_block", "entry_number"))
    order, groups = np.argsort(blocks, kind="stable"), row["groups"].to_pylist()
    for some in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        own = of[some]
        yield int(blocks[some[0]]), len(some), _packed(numbers[some].astype("<i4"), *(x[own].astype("<i8") for x in results), text="\n".join([groups[k] for k in own.tolist()]))


def _as_batch(rows: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["own", "n", "results"])


def _scored(table: Broadcast):
    """Chunks with the counts of all pairs at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _as_batch(_sent_back({c: batch.column(c)[k].values for c in batch.schema.names if c != "chunk"}, *table.value))

    return run


def _scored_by_join(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """One chunk with the counts of its own pairs."""
    pairs = pairs.sort_by("pair")
    table = (pairs.column(c).to_numpy() for c in ("pair", "count", "best"))
    return pa.Table.from_batches([_as_batch(_sent_back({c: rows.column(c)[0].values for c in rows.schema.names if c != "chunk"}, *table))])


def _composed(kind: pa.DataType):
    def run(blocks: pa.Table, entries: pa.Table) -> pa.Table:
        parts = [_unpacked(data, n, *_KINDS) for n, data in zip(entries.column("n").to_pylist(), entries.column("results").to_pylist(), strict=True)]
        number, *columns = (np.concatenate(x) for x in zip(*(p for p, _ in parts), strict=True))
        groups = [g for _, text in parts for g in text.split("\n")]
        place = np.empty(len(number), np.int64)
        place[number] = np.arange(len(number))
        n = blocks.column("n")[0].as_py()
        (planes,), _ = _unpacked(blocks.column("numbers")[0].as_py(), 4 * n, "u1")
        own = place[np.ascontiguousarray(planes.reshape(4, n).T).view("<i4")[:, 0]]
        edge = np.concatenate([[0], np.cumsum(blocks.column("sizes")[0].values.to_numpy())])
        sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(column[own])])[edge])) for column in columns]
        order, at = own.tolist(), edge.tolist()
        texts = pa.array([";".join([groups[k] for k in order[i:j]]) for i, j in zip(at, at[1:])], pa.string())
        return pa.table([blocks.column("ids")[0].values.cast(kind), *sums, texts], names=["id", *_NUMBERS, "groups"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Of each row: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is as frequent in the corpus as any of their B id), count_sum (their pairs' counts), and groups: A ids, "|", B ids, between ";"."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    schema = StructType().add("block", "long").add("ids", ArrayType(id_type)).add("sizes", ArrayType(LongType())).add("n", "long").add("numbers", "binary").add("segments", ArrayType(StringType())).add("counts", ArrayType(LongType()))
    blocks = staged(rows.mapInArrow(_blocks(path_b, block), schema), "alignment-blocks")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("segments", "counts")).alias("number", "entry")).select(F.col("entry.segments").alias("segment"), "block", F.col("number").cast("long").alias("number"), F.col("entry.counts").alias("n"))
    by_segment = entries.repartition("segment").sortWithinPartitions("segment")
    aligned_ = staged(by_segment.mapInArrow(_align(path_a, path_b, chunk), ", ".join(f"{n} {k}" for n, k in _COLUMNS.items())), "alignment-chunks", compression="zstd")
    counted = aligned_.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = cut_small(counted.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).cast("long").alias("best")))
    own, results = aligned_.drop("pairs", "pair_counts"), "own long, n long, results binary"
    if pairs.count() <= BROADCAST:
        table = pairs.toArrow().sort_by("pair")
        found = own.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "count", "best")])), results)
    else:
        of_chunks = aligned_.select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair")).join(pairs, "pair")
        found = own.groupBy("chunk").cogroup(of_chunks.groupBy("of")).applyInArrow(_scored_by_join, results)
    schema = StructType().add("id", id_type)
    for name in _NUMBERS:
        schema = schema.add(name, "long")
    # Blocks without any segment have no entries: their documents have no tokens.
    some = blocks.where("n > 0").select("block", "ids", "sizes", "n", "numbers").groupBy("block").cogroup(found.groupBy("own"))
    out = some.applyInArrow(_composed(to_arrow_type(id_type)), schema.add("groups", "string"))
    none = blocks.where("n = 0").select(F.explode("ids").alias("id"), *(F.lit(0).cast("long").alias(name) for name in _NUMBERS), F.lit("").alias("groups"))
    return out.unionByName(none)

"""Packing of documents' token ids into sequences of one size: bounded-space online best fit, then a merge of leftovers.

A document's ids, with an end id, are cut into whole sequences and a rest. Each partition keeps at most SPACES open
windows; a rest goes into the one that it leaves fullest. Where none has room and all are open, the fullest one is
given out: its gap is filled with the beginning of the piece in hand, unless the gap is under LEAST ids, which stay
padding. Windows that are open at a partition's end are leftovers: the leftovers of GROUP partitions at a time are
packed the same way in one task, in rounds, until one group is left. What is open after that is filled up one by
one, and the last window is cut into sequences of lengths that are powers of two, which need no padding.

Nothing depends on the order in which tasks run: a partition's rows come in the order of its files, leftovers are
sorted by partition and window. A round holds GROUP x SPACES windows a task at most.

Defined results: null and empty texts are the end id alone; repeated rows are packed each for itself; null ids stay
null; very long texts are cut like others; an empty table gives an empty result; columns other than id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, staged, text_bytes
from .segments import byte_level_encoder

SIZE = 1024
END = 0
#: Open windows of a partition.
SPACES = 64
#: A gap of fewer ids is left as padding rather than filled with the beginning of a document.
LEAST = 16
#: Partitions whose leftovers are packed in one task.
GROUP = 64
#: Bytes of text that are encoded together.
PIECE = 8 << 20


@dataclass(order=True)
class Piece:
    """ids[0:] of a document from its place `start` on."""

    length: int
    doc: object = field(compare=False)
    start: int = field(compare=False)
    total: int = field(compare=False)
    ids: np.ndarray = field(compare=False)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(n, self.doc, self.start, self.total, self.ids[:n]), Piece(self.length - n, self.doc, self.start + n, self.total, self.ids[n:])


class Packer:
    """Windows that are open, by the room that they have left, and those that are given out."""

    def __init__(self, size: int, spaces: int, least: int) -> None:
        self.size, self.spaces, self.least = size, spaces, least
        #: (room, window) in ascending order.
        self.rooms: list[tuple[int, int]] = []
        self.open: dict[int, list[Piece]] = {}
        self.done: list[list[Piece]] = []
        self.next = 0

    def _put(self, at: int, piece: Piece) -> None:
        room, window = self.rooms.pop(at)
        self.open[window].append(piece)
        if room == piece.length:
            self.done.append(self.open.pop(window))
        else:
            insort(self.rooms, (room - piece.length, window))

    def add(self, piece: Piece) -> None:
        while piece.length > self.size:
            whole, piece = piece.cut(self.size)
            self.done.append([whole])
        while True:
            at = bisect_left(self.rooms, (piece.length, -1))
            if at < len(self.rooms):
                return self._put(at, piece)
            if len(self.rooms) < self.spaces:
                self.open[self.next] = []
                insort(self.rooms, (self.size, self.next))
                self.next += 1
            elif self.rooms[0][0] < self.least:
                self.done.append(self.open.pop(self.rooms.pop(0)[1]))
            else:
                head, piece = piece.cut(self.rooms[0][0])
                self._put(0, head)

    def given_out(self) -> list[list[Piece]]:
        out, self.done = self.done, []
        return out

    def leftovers(self) -> list[list[Piece]]:
        out = [self.open[w] for _, w in self.rooms]
        self.rooms, self.open = [], {}
        return out


def powers_of_two(window: list[Piece]) -> list[list[Piece]]:
    """The pieces of a window in sequences whose lengths are powers of two, the longest first."""
    left, out, pieces = sum(p.length for p in window), [], list(reversed(window))
    while left:
        goal = room = 1 << (left.bit_length() - 1)
        sequence = []
        while room:
            piece = pieces.pop()
            if piece.length > room:
                piece, rest = piece.cut(room)
                pieces.append(rest)
            sequence.append(piece)
            room -= piece.length
        out.append(sequence)
        left -= goal
    return out


_NAMES = ["id", "start", "length", "doc_tokens", "part", "window", "offset", "open", "ids"]


def _rows(windows: list[list[Piece]], part: int, first: int, is_open: bool, kind: pa.DataType) -> pa.RecordBatch:
    """One row for each piece."""
    flat = [(p, first + k) for k, w in enumerate(windows) for p in w]
    offsets = [at for w in windows for at in np.cumsum([0, *(p.length for p in w)])[:-1].tolist()]
    n = len(flat)
    columns = [
        pa.array([p.doc for p, _ in flat], kind),
        *(pa.array([getattr(p, name) for p, _ in flat], pa.int64()) for name in ("start", "length", "total")),
        pa.array([part] * n, pa.int64()),
        pa.array([w for _, w in flat], pa.int64()),
        pa.array(offsets, pa.int64()),
        pa.array([is_open] * n, pa.bool_()),
        pa.array([p.ids.tobytes() for p, _ in flat], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _pack(path: str, end: int, size: int, spaces: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, packer, n_out = byte_level_encoder(path), TaskContext.get().partitionId(), Packer(size, spaces, least), 0
        kind = None
        for batch in batches:
            kind, texts = batch.schema.field(0).type, batch.column(1)
            names, (_, offsets) = batch.column(0).to_pylist(), text_bytes(texts)
            for a, b in chunks(offsets, PIECE):
                ids, counts = own.encode(texts.slice(a, b - a))
                at = 0
                for doc, n in zip(names[a:b], counts.tolist(), strict=True):
                    # Copies: a window must not hold the whole batch's ids.
                    packer.add(Piece(n + 1, doc, 0, n + 1, np.append(ids[at : at + n], np.uint32(end)).astype("<u4")))
                    at += n
                windows = packer.given_out()
                if windows:
                    yield _rows(windows, part, n_out, False, kind)
                n_out += len(windows)
        windows = packer.leftovers()
        if windows:
            yield _rows(windows, part, n_out, True, kind)

    return run


def _merge(size: int, spaces: int, least: int, base: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        kind = rows.schema.field("id").type
        rows = rows.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        take = [rows.column(n).to_pylist() for n in ("length", "id", "start", "doc_tokens", "ids")]
        pieces = [Piece(n, doc, start, total, np.frombuffer(ids, "<u4")) for n, doc, start, total, ids in zip(*take, strict=True)]
        packer = Packer(size, spaces, least)
        # The longest first; equal ones in their order.
        for piece in sorted(pieces, reverse=True):
            packer.add(piece)
        done, rest = packer.given_out(), packer.leftovers()
        if last:
            packer = Packer(size, 1, 1)
            for window in rest:
                for piece in window:
                    packer.add(piece)
            done += packer.given_out()
            done += [s for w in packer.leftovers() for s in powers_of_two(w)]
            rest = []
        part = base + key[0].as_py()
        return pa.Table.from_batches([_rows(done, part, 0, False, kind), _rows(rest, part, len(done), True, kind)])

    return run


def pack(docs: DataFrame, path: str, end: int = END, size: int = SIZE, spaces: int = SPACES, least: int = LEAST, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit). size is a power of two."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType(rows.schema.fields[:1])
    for name in _NAMES[1:7]:
        schema = schema.add(name, "long")
    schema = schema.add("open", "boolean").add("ids", "binary")
    found = staged(rows.mapInArrow(_pack(path, end, size, spaces, least), schema), "packing")
    out, left = found.where("not open"), found.where("open")
    # Parts are numbered on: partitions first, then the groups of each round.
    base, parts = 0, found.agg(F.coalesce(F.max("part") + 1, F.lit(0))).first()[0]
    while parts:
        groups = -(-parts // group)
        by_group = left.groupBy(F.floor((F.col("part") - base) / group).alias("_group"))
        merged = staged(by_group.applyInArrow(_merge(size, spaces, least, base + parts, groups == 1), schema), "packing-leftovers")
        out, left = out.unionByName(merged.where("not open")), merged.where("open")
        base, parts = base + parts, 0 if groups == 1 else groups
    return out.select("id", "start", "length", "doc_tokens", (F.shiftleft("part", 32) + F.col("window")).alias("sequence_id"), "offset", "ids")

"""Byte-level BPE with the ranks of a vocabulary file: segment trees hold the leftmost minimum pair rank.

The leaves of a tree are the byte places of one match of the split pattern; a leaf holds the rank of the pair
that starts there, an inner node the smaller of its children, ties to the left. The root names the next
merge; a merge changes the leaves of the live neighbours only, each with a logarithmic number of updates.

Matches of a batch that have not been met before are merged together: trees of one size are rows of an
array, and a step performs one merge in each. A long match has a tree of its own. Ids of matches are kept in
a bounded cache. Texts are split whole, decoded ids give the text's bytes back.

Defined results: null and empty texts have no ids; repeated rows have equal ids; strings of special tokens are
ordinary text; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches that a worker keeps the ids of, and stretches between blanks.
CACHE = 400_000
#: Longer matches have a tree of their own.
LONG = 64
_NONE = np.int64(1) << 40
#: White space as the pattern's \s has it.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


class Tree:
    """Leftmost minimum over leaves, with point updates."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        none = int(_NONE)
        self.node = [none] * self.size + leaves + [none] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            a, b = self.node[2 * k], self.node[2 * k + 1]
            self.node[k] = a if a <= b else b

    def least(self) -> tuple[int, int]:
        """Rank and place."""
        k, value = 1, self.node[1]
        while k < self.size:
            k = 2 * k if self.node[2 * k] == value else 2 * k + 1
        return value, k - self.size

    def put(self, place: int, value: int) -> None:
        node, k = self.node, self.size + place
        node[k] = value
        while k > 1:
            k >>= 1
            a, b = node[2 * k], node[2 * k + 1]
            now = a if a <= b else b
            if node[k] == now:
                return
            node[k] = now


class Vocabulary:
    """Ranks of byte strings, and of pairs of them whose join has a rank."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.word = {r: np.int32(r).tobytes() for r in self.token}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pair = {}
        for whole, r in self.rank.items():
            for k in range(1, len(whole)):
                a, b = self.rank.get(whole[:k]), self.rank.get(whole[k:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = r
        # An open hash table for look-ups of whole arrays.
        self.bits = (4 * len(self.pair)).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int64)
        key, value = np.fromiter(self.pair, np.int64), np.fromiter(self.pair.values(), np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = key[free], value[free]
            lost = self.keys[slot] != key
            key, value, slot = key[lost], value[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)
        for at in np.flatnonzero(self.keys >= 0):
            self.values[at] = self.pair[int(self.keys[at])]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined pairs; _NONE where a pair has none or a side is missing (-1)."""
        key = np.where((left < 0) | (right < 0), np.int64(1) << 45, left << 20 | right)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    # -- one match ------------------------------------------------------------------------------------

    def merged(self, piece: bytes) -> list[int]:
        if (r := self.rank.get(piece)) is not None:
            return [r]
        n, pair, none = len(piece), self.pair, int(_NONE)
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = Tree([pair.get(ids[i] << 20 | ids[i + 1], none) for i in range(n - 1)])
        while True:
            r, i = tree.least()
            if r == none:
                break
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            tree.put(j, none) if j < n - 1 else None
            if k < n:
                before[k] = i
                tree.put(i, pair.get(r << 20 | ids[k], none))
            else:
                tree.put(i, none)
            if (h := before[i]) >= 0:
                tree.put(h, pair.get(ids[h] << 20 | r, none))
        return [x for x in ids if x >= 0]

    # -- many matches ---------------------------------------------------------------------------------

    def merged_all(self, pieces: list[bytes]) -> list[bytes]:
        """As merged(), for each piece; ids as 32-bit words."""
        rank, word = self.rank, self.word
        out: list[bytes | None] = [word[rank[p]] if p in rank else None for p in pieces]
        todo: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if out[k] is None:
                if len(p) > LONG:
                    out[k] = np.array(self.merged(p), np.int32).tobytes()
                else:
                    todo.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(k)
        for width, which in todo.items():
            step = max(64, (1 << 18) // width)
            for at in range(0, len(which), step):
                some = which[at : at + step]
                for k, ids in zip(some, self._rows([pieces[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def _rows(self, pieces: list[bytes], width: int) -> Iterator[bytes]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        inside = np.arange(width) < size[:, None]
        ids = np.where(inside, self.single[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        # A node holds rank * width + place, so the smaller of two is the leftmost minimum.
        none = int(_NONE) * width
        tree = np.full((n, 2 * width), none, np.int64)
        ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(ranks < _NONE, ranks * width + np.arange(width - 1), none)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            k = place + width
            tree[row, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

        def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
            return np.where(rank < _NONE, rank * width + place, none)

        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            best = tree[live, 1]
            i, r = best % width, best // width
            j = after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j] = r, -1
            after[live, i] = k
            put(live, j, np.full(len(live), none))
            more = k < width
            before[live[more], k[more]] = i[more]
            right = np.where(more, ids[live, np.minimum(k, width - 1)], -1)
            put(live, i, leaf(self.ranks(r, right), i))
            h = before[live, i]
            had = h >= 0
            if had.any():
                rows, h = live[had], h[had]
                put(rows, h, leaf(self.ranks(ids[rows, h], r[had]), h))
            live = live[tree[live, 1] < none]
        kept = ids >= 0
        flat = ids[kept].astype(np.int32).tobytes()
        at = 0
        for c in (4 * kept.sum(axis=1)).tolist():
            yield flat[at : at + c]
            at += c


class Encoder:
    """Splits, merges and decodes whole texts."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(pattern)
        # Matches never go on past a stretch. Ids are held as bytes: small, and nothing for the garbage collector.
        self.stretches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its ids."""
        split = [_STRETCH.findall(t) if t else [] for t in texts]
        if len(self.stretches) > CACHE:
            self.stretches = {}
        if len(self.pieces) > CACHE:
            self.pieces = {}
        stretches, pieces = self.stretches, self.pieces
        new = list({s for x in split for s in x if s not in stretches})
        parts = [self.pattern.findall(s) for s in new]
        fresh = list({p for x in parts for p in x if p not in pieces})
        pieces.update(zip(fresh, self.vocabulary.merged_all([p.encode() for p in fresh]), strict=True))
        for s, x in zip(new, parts, strict=True):
            stretches[s] = pieces[x[0]] if len(x) == 1 else b"".join([pieces[p] for p in x])
        return [np.frombuffer(b"".join([stretches[s] for s in x]), np.int32) for x in split]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """A worker's encoder."""
    return Encoder(path, pattern)


def _parts(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            at = 0
            for part in _parts(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(own.encode(part), pa.list_(pa.int32()))], names=["id", "ids"])
                at += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id and bytes of each row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 (of the decimal ids, joined by one space) and decoded_sha256 (of the decoded ids); ids do not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        decimal = {r: str(r) for r in own.vocabulary.token}.__getitem__
        for batch in batches:
            at = 0
            for part in _parts(batch.column(1).to_pylist()):
                out = []
                for x in own.encode(part):
                    out.append((len(x), hashlib.sha256(" ".join(map(decimal, x.tolist())).encode()).hexdigest(), hashlib.sha256(own.decode(x)).hexdigest()))
                n, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)

"""Token ids in files of shuffled planes, in ascending order of the documents' ids.

Texts are ranged by id, encoded, and packed into shards. A shard holds whole documents: their ids and token
counts, then blocks of BLOCK token ids. A block is turned into bit planes or byte planes (all first bytes, all second
bytes, ...), each compressed with zstandard; an index at the end has the place and size of every plane, so a
block or a plane can be read alone. Shards are the binary rows of a Parquet table, which Spark's committers
write to the shared folder: a lost executor's shard is written again, and no shard counts twice.

Format of a shard, integers little-endian: "CWPLANE1", u8 planes per block, u32 block, u64 ids, u32 documents;
two zstandard frames with the documents' ids (i64; the least value stands for null) and counts (u64), each
after its u32 length; the planes; the index (a u64 place and a u32 size for each plane); u64 place of the index.

Defined results: null and empty texts are one end id; repeated rows follow each other; null ids come first;
an empty table gives no shards and an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, staged, text_bytes

BLOCK = 1 << 16
#: Ids of a shard, apart from its last document.
SHARD = 1 << 20
END = 2
#: Bytes of text whose stretches are numbered together.
PIECE = 8 << 20
CACHE = 600_000
_MAGIC, _NULL = b"CWPLANE1", -(1 << 63)
_HEAD = struct.Struct("<8sBIQI")
#: Stretches that fall into letters, digits and signs in a way that needs no library; "'" and "<" may join these.
_PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PART = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


# -- the format --------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes of 32-bit ids, or bit planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        lanes = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(lanes[:, k], bitorder="little").tobytes() for k in range(32)]
    return [raw[:, k].tobytes() for k in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        lanes = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        return np.packbits(lanes, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4") if n else np.zeros(0, "<u4")


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = 1) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    out = [_HEAD.pack(_MAGIC, 32 if bits else 4, block, len(ids), len(doc_ids))]
    for part in (np.array([_NULL if d is None else d for d in doc_ids], "<i8"), np.array(counts, "<u8")):
        frame = press.compress(part.tobytes())
        out += [struct.pack("<I", len(frame)), frame]
    at, index = sum(map(len, out)), []
    for first in range(0, len(ids), block):
        for plane in to_planes(ids[first : first + block], bits):
            frame = press.compress(plane)
            index.append(struct.pack("<QI", at, len(frame)))
            out.append(frame)
            at += len(frame)
    return b"".join([*out, *index, struct.pack("<Q", at)])


class Shard:
    """A shard's documents, and its ids by block."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        magic, self.planes, self.block, self.n, n_docs = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at, parts = _HEAD.size, []
        self._open = zstandard.ZstdDecompressor()
        for kind in ("<i8", "<u8"):
            (size,) = struct.unpack_from("<I", data, at)
            parts.append(np.frombuffer(self._open.decompress(data[at + 4 : at + 4 + size]), kind) if n_docs else np.zeros(0, kind))
            at += 4 + size
        self.doc_ids, self.counts = parts
        (self.index,) = struct.unpack_from("<Q", data, len(data) - 8)

    def read_block(self, k: int) -> np.ndarray:
        planes = []
        for p in range(self.planes):
            at, size = struct.unpack_from("<QI", self.data, self.index + 12 * (k * self.planes + p))
            planes.append(self._open.decompress(self.data[at : at + size]))
        return from_planes(planes, min(self.block, self.n - k * self.block))

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *(self.read_block(k) for k in range(-(-self.n // self.block)))])


# -- encoding ----------------------------------------------------------------------------------------------


class Encoder:
    """The library's ids of whole texts. Merges never reach across blanks, so each stretch is encoded once."""

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Stretches that are known: their numbers; where their ids begin in the pool, and how many there are."""
        self.numbers: dict[str, int] = {"": 0}
        self.begin, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _one_by_one(self, parts: list[str]) -> dict[str, bytes]:
        return {p: np.array(e.ids, np.uint32).tobytes() for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True)}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Words in one text: each word's last id, and no other, ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words) or stop[-1] != len(ids):
            return self._one_by_one(words)
        raw, edge = ids.tobytes(), [0, *(4 * stop).tolist()]
        return {w: raw[a:b] for w, a, b in zip(words, edge, edge[1:])}

    def _learn(self, new: list[str]) -> None:
        """Encodes stretches that are not known yet."""
        if len(self.parts) > CACHE:
            self.parts = {}
        parts = self.parts
        plain = [bool(_PLAIN.fullmatch(s)) for s in new]
        pieces = [_PART.findall(s.lower()) if ok else [s] for s, ok in zip(new, plain, strict=True)]
        words = list({p for x, ok in zip(pieces, plain, strict=True) if ok for p in x if p not in parts})
        for at in range(0, len(words), 4096):
            parts.update(self._words(words[at : at + 4096]))
        other = list({x[0] for x, ok in zip(pieces, plain, strict=True) if not ok and x[0] not in parts})
        parts.update(self._one_by_one(other))
        ids = [parts[x[0]] if len(x) == 1 else b"".join([parts[p] for p in x]) for x in pieces]
        size = np.array(list(map(len, ids)), np.int64) // 4
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each text has. Stretches between blanks are split and numbered by Arrow, and their ids are gathered."""
        if len(self.numbers) > CACHE:
            self._forget()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        self._learn([s for s in names if s not in self.numbers])
        number = np.array([self.numbers[s] for s in names], np.int64)[words.indices.to_numpy()] if names else np.zeros(0, np.int64)
        size = self.size[number]
        end = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[number] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        # The end ids go between the texts.
        edge = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        upto = np.concatenate([[0], end])[edge]
        stop = upto[1:] + np.arange(len(texts))
        out = np.full(len(ids) + len(texts), self.end, np.uint32)
        own = np.ones(len(out), bool)
        own[stop] = False
        out[own] = ids
        return out, np.diff(upto) + 1


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, end)


def _write(path: str, end: int, block: int, shard: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path, end), TaskContext.get().partitionId()
        seq, held = 0, 0
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, held, docs, counts, ids
            data = write_shard(docs, np.concatenate(counts).tolist(), np.concatenate(ids), block, bits)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_ids", "payload"])
            seq, held, docs, counts, ids = seq + 1, 0, [], [], []
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            _, offsets = text_bytes(texts)
            for a, b in chunks(offsets, PIECE):
                found, n = own.encode(texts.slice(a, b - a))
                upto = np.concatenate([[0], np.cumsum(n)])
                at = 0
                while at < b - a:
                    # As many documents as bring the shard to its size.
                    stop = min(b - a, max(at + 1, int(np.searchsorted(upto, upto[at] + shard - held))))
                    docs += names[a + at : a + stop]
                    counts.append(n[at:stop])
                    ids.append(found[upto[at] : upto[stop]])
                    held += int(upto[stop] - upto[at])
                    at = stop
                    if held >= shard:
                        yield close()
        if docs:
            yield close()

    return run


def write(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, shard: int = SHARD, bits: bool = False) -> DataFrame:
    """The table of shards: part and seq (their order), n_ids, payload."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return staged(rows.mapInArrow(_write(path, end, block, shard, bits), "part int, seq int, n_ids long, payload binary"), "planes")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = Shard(data.as_py())
            ends = np.cumsum(shard.counts.astype(np.int64))
            starts = ends - shard.counts.astype(np.int64)
            words = memoryview(shard.ids().astype("<u4").tobytes())
            crc = [zlib.crc32(words[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crc)
            names = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == _NULL)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), names, pa.array(starts), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "seq", "id", "local", "n_tokens", "ids_crc32"])


def read(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each document, from the shards: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = shards.select("part", "seq", "payload").mapInArrow(_read, "part int, seq int, id long, local long, n_tokens long, ids_crc32 long")
    # Sums by partition first: what one task orders is a row for each partition, then one for each of its shards.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")
    out = rows.join(starts, ["part", "seq"])
    return out.select(F.col("id").alias(id_col), (F.col("part_start") + F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

"""BAM files read in parts and written in parts, by Spark's own readers and committers.

A BAM file is a row of compressed blocks. Spark's text source splits a file at the four bytes with which each block
begins, wherever the file is stored, so a large file is as many tasks as it has splits. Blocks are inflated one by
one. A split other than a file's first begins within a record: the first place from which several records follow
each other is taken as a start. What lies before it, and what is left over at a split's end, are fragments; those
that belong together are joined by file and must come out as whole records, or the run stops.

Files are written the same way: a row is a block, and the line separator an empty block, which readers skip and
which marks the end of a file.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folders import shared_folder

# Fixed values of the formats: a block's first bytes, the empty block, operations and bases by code, sizes of tags' values.
MAGIC = b"\x1f\x8b\x08\x04"
EMPTY = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Bytes of records in a block that is written; the format allows 65,536 compressed ones.
BLOCK = 60_000
#: Records that have to follow each other from a place that is taken as a start, and the bytes that are looked at first.
CHAIN, LOOK = 5, 1 << 20

_FIXED = struct.Struct("<iiBBHHHiiii")
#: Hexadecimal digits of the bases' codes, to bases and back; what is no base is N.
_FROM_HEX = str.maketrans("0123456789abcdef", BASES)
_TO_HEX = bytes(b"0123456789abcdef"[BASES.find(c) if (c := chr(x).upper()) in BASES else 15] for x in range(256))
_SHOWN = bytes(min(q + 33, 126) for q in range(256))
_HIDDEN = bytes((x - 33) % 256 for x in range(256))


# -- blocks ------------------------------------------------------------------------------------------------


def block_size(raw: bytes) -> int:
    """The length of the block that begins raw; 0 if none begins there."""
    if len(raw) < 18 or raw[:4] != MAGIC:
        return 0
    at, end = 12, 12 + int.from_bytes(raw[10:12], "little")
    while at + 4 <= min(end, len(raw)):
        size = int.from_bytes(raw[at + 2 : at + 4], "little")
        if raw[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(raw[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def inflated(raw: bytes) -> bytes:
    """The contents of one block, which its checksum has to confirm."""
    out = zlib.decompress(raw[12 + int.from_bytes(raw[10:12], "little") : -8], wbits=-15)
    if (zlib.crc32(out), len(out)) != struct.unpack("<II", raw[-8:]):
        raise ValueError("a block's checksum is wrong")
    return out


def deflated(data: bytes) -> bytes:
    """A block of these contents."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    return MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


# -- records -----------------------------------------------------------------------------------------------


def _long_cigar(row: bytes, at: int) -> tuple[int, ...]:
    """The operations in a record's tag CG; none without it."""
    while at < len(row):
        tag, kind = row[at : at + 2], chr(row[at + 2])
        at += 3
        if kind in "ZH":
            at = row.index(0, at) + 1
        elif kind == "B":
            n = struct.unpack_from("<i", row, at + 1)[0]
            if tag == b"CG":
                return struct.unpack_from(f"<{n}I", row, at + 5)
            at += 5 + n * SIZES[chr(row[at])]
        else:
            at += SIZES[kind]
    return ()


@lru_cache(maxsize=1 << 14)
def _shown_cigar(ops: tuple[int, ...]) -> str:
    return "".join([f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops])


@lru_cache(maxsize=1 << 14)
def _operations(cigar: str) -> tuple[tuple[int, ...], int, bytes]:
    """A CIGAR's operations, the places that they take on the reference, and their bytes."""
    ops = tuple(int(n) << 4 | OPERATIONS.index(op) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar))
    return ops, sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8)), struct.pack(f"<{len(ops)}I", *ops)


def decoded(row: bytes) -> tuple:
    """name, flag, number of the reference, pos (from 1), mapq, cigar, seq, qual of a record, as SAM text has them. A CIGAR of too many operations for its field is taken from its tag."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", row)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", row, at)
    name, at = row[32 : at - 1].decode(), at + 4 * n_ops
    half = (n_seq + 1) // 2
    if n_ops == 2 and ops[0] == n_seq << 4 | 4 and ops[1] & 15 == 3:
        ops = _long_cigar(row, at + half + n_seq) or ops
    seq = row[at : at + half].hex().translate(_FROM_HEX)[:n_seq]
    qual = row[at + half : at + half + n_seq]
    # Long lists of operations are not kept.
    cigar = _shown_cigar(ops) if len(ops) < 64 else _shown_cigar.__wrapped__(ops)
    return name, flag, ref, pos + 1, mapq, cigar or "*", seq or "*", "*" if not qual or qual[0] == 255 else qual.translate(_SHOWN).decode()


def encoded(name: str, flag: int, ref: int, pos: int, mapq: int, cigar: str, seq: str, qual: str) -> bytes:
    """A record of these values, with its length; without mates and tags, but for CG if there are over 65,535 operations."""
    ops, span, packed = _operations(cigar) if len(cigar) < 256 else _operations.__wrapped__(cigar)
    n = 0 if seq == "*" else len(seq)
    last = pos - 1 + max(1, span)
    tag, n_ops = b"", len(ops)
    if n_ops > 65_535:
        tag = b"CGBI" + struct.pack("<i", n_ops) + packed
        packed, n_ops = struct.pack("<2I", n << 4 | 4, (last - pos + 1) << 4 | 3), 2
    own = name.encode()
    row = _FIXED.pack(ref, pos - 1, len(own) + 1, mapq, _bin(pos - 1, last), n_ops, flag, n, -1, -1, 0)
    row += own + b"\0" + packed
    if n:
        row += bytes.fromhex((seq.encode("latin-1", "replace").translate(_TO_HEX) + b"0" * (n % 2)).decode())
    if qual == "*" or len(qual) != n:
        row += b"\xff" * n
    elif n and min(qual) < "!":
        raise ValueError(f"a quality of {name} is no printable character")
    else:
        row += qual.encode("latin-1").translate(_HIDDEN)
    return struct.pack("<i", len(row) + len(tag)) + row + tag


def _bin(first: int, end: int) -> int:
    """The format's number of the smallest stretch that holds places first to end - 1: of eighths of eighths of the whole, down to 16,384 places."""
    for depth in range(5, 0, -1):
        width = 14 + 3 * (5 - depth)
        if first >> width == (end - 1) >> width:
            return ((1 << 3 * depth) - 1) // 7 + (max(first, 0) >> width) if first >= 0 else 4680
    return 0


def header(refs: Sequence[tuple[str, int]]) -> bytes:
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{name}\tLN:{n}\n" for name, n in refs)
    out = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs))
    return out + b"".join(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n) for name, n in refs)


def _after_header(data: bytes) -> tuple[int, list[str]] | None:
    """Where the first record begins, and the references' names; None if the header goes on."""
    if len(data) >= 4 and data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return (at, names) if at <= len(data) else None


def _plausible(data: bytes, at: int) -> int:
    """The length of a record that may begin here, with its own; 0 if none can; -1 if too little is left to tell."""
    if at + 36 > len(data):
        return -1
    size = struct.unpack_from("<i", data, at)[0]
    ref, pos, n_name, _, _, n_ops, _, n_seq, next_ref, next_pos, _ = _FIXED.unpack_from(data, at + 4)
    if size < 33 or min(ref, pos, next_ref, next_pos) < -1 or n_name < 2 or n_seq < 0 or 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size:
        return 0
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or min(name[:-1]) < 33 or max(name[:-1]) > 126):
        return 0
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_ops : 4]
    return 0 if any(x & 15 > 8 for x in ops) else 4 + size


def first_start(data: bytes) -> int | None:
    """The first place from which CHAIN records follow each other, or at least one up to the very end; None without one."""
    for at in range(len(data) - 35):
        here, n = at, 0
        while n < CHAIN and (size := _plausible(data, here)) > 0 and here + size <= len(data):
            here, n = here + size, n + 1
        if n == CHAIN or n and here == len(data):
            return at
    return None


# -- splits ------------------------------------------------------------------------------------------------


class _Split:
    """One split of a file: its blocks come in, records go out."""

    def __init__(self, path: str, first: int) -> None:
        self.path, self.first, self.open, self.data = path, first, b"", b""
        self.refs: list[str] | None = None
        self.head: bytes | None = None

    def add(self, value: bytes) -> Iterator[bytes]:
        # The four bytes may also stand within a block: then it goes on in the next row.
        raw = self.open + MAGIC + value if self.open else MAGIC + value
        size = block_size(raw)
        if not size or len(raw) > size:
            raise ValueError(f"{self.path}: no whole block at a place where one should begin; another spark.sql.files.maxPartitionBytes may help if the file is sound")
        self.open = raw if len(raw) < size else b""
        if not self.open:
            self.data += inflated(raw)
            if self.first == 0 and self.refs is None:
                found = _after_header(self.data)
                if found:
                    self.head, self.refs, self.data = b"", found[1], self.data[found[0] :]
            elif self.head is None and len(self.data) >= LOOK:
                self._begin()
            yield from self._records()

    def _begin(self) -> None:
        at = first_start(self.data)
        if at is not None:
            self.head, self.data = self.data[:at], self.data[at:]

    def _records(self) -> Iterator[bytes]:
        at = 0
        while self.head is not None and at + 4 <= len(self.data):
            size = int.from_bytes(self.data[at : at + 4], "little", signed=True)
            if size < 32:
                raise ValueError(f"{self.path}: no record where one should begin")
            if at + 4 + size > len(self.data):
                break
            yield self.data[at + 4 : at + 4 + size]
            at += 4 + size
        self.data = self.data[at:]

    def end(self) -> Iterator[bytes]:
        if self.open or self.first == 0 and self.refs is None:
            raise ValueError(f"{self.path}: a block or the header isn't whole; another spark.sql.files.maxPartitionBytes may help if the file is sound")
        if self.head is None:
            self._begin()
        yield from self._records()


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Split, Iterator[bytes]]]:
    """Each split with records as they come; at its end once more, with the last ones."""
    now: _Split | None = None
    for batch in batches:
        for path, first, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or (now.path, now.first) != (path, first):
                if now is not None:
                    yield now, now.end()
                now = _Split(path, first)
                if first == 0 and value == b"":
                    continue  # nothing stands before a file's first block
            yield now, now.add(value)
    if now is not None:
        yield now, now.end()


_FRAGMENT = "path string, first long, starts boolean, head binary, tail binary, refs array<string>"
_RECORD = "path string, name string, flag int, number int, pos int, mapq int, cigar string, seq string, qual string"
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: _Split | None = None

    def shown(s: _Split) -> pa.RecordBatch:
        starts = s.head is not None
        row = [s.path, s.first, starts, s.head if starts else s.data, s.data if starts else b"", s.refs]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["path", "first", "starts", "head", "tail", "refs"])

    for split, records in _splits(batches):
        if last is not None and split is not last:
            yield shown(last)
        last = split
        for _ in records:
            pass
    if last is not None:
        yield shown(last)


def _as_rows(path: str, found: list[bytes]) -> pa.RecordBatch:
    columns = list(zip(*((path, *decoded(r)) for r in found), strict=True)) or [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[c.split()[0] for c in _RECORD.split(", ")])


def _whole_records(until: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        path = None
        for split, records in _splits(batches):
            if held and split.path != path:
                yield _as_rows(path, held)
                held = []
            path = split.path
            for r in records:
                if until is None or int.from_bytes(r[4:8], "little", signed=True) < until:
                    held.append(r)
            if len(held) >= 10_000:
                yield _as_rows(path, held)
                held = []
        if held:
            yield _as_rows(path, held)

    return run


def _joined(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The records of fragments that follow each other in a file."""
    rows = rows.sort_by([("first", "ascending"), ("side", "ascending")])
    data, at, found = b"".join(rows.column("data").to_pylist()), 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little", signed=True)
        if size < 32 or at + 4 + size > len(data):
            raise ValueError(f"{key[0].as_py()}: the file ends within a record, or is damaged")
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return pa.Table.from_batches([_as_rows(key[0].as_py(), found)])


def records(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """file, name, flag, ref, pos (from 1), mapq, cigar, seq, qual of every record, as SAM text has them; until: only those that begin at or before that place.

    Files are scanned twice: for headers and for the fragments at the ends of splits, a row for each split, and
    for the records. A file without records gives none; files in different folders may share a name.
    """
    blocks = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("first"), F.col("value").cast("binary").alias("value"))
    shared_folder(spark)
    ends = blocks.mapInArrow(_fragments, _FRAGMENT).checkpoint()
    order = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    ends_ = ends.withColumn("group", F.sum(F.col("starts").cast("int")).over(order))
    sides = F.array(F.struct((F.col("group") - F.col("starts").cast("int")).alias("group"), F.lit(0).alias("side"), F.col("head").alias("data")), F.struct("group", F.lit(1).alias("side"), F.col("tail").alias("data")))
    pieces = ends_.select("path", "first", F.explode(sides).alias("s")).select("path", "first", "s.*").where(F.length("data") > 0)
    found = blocks.mapInArrow(_whole_records(until), _RECORD).unionByName(pieces.groupBy("path", "group").applyInArrow(_joined, _RECORD))
    found = found if until is None else found.where(F.col("pos") <= until)
    refs = ends.where("refs is not null").select("path", F.posexplode("refs").alias("number", "ref"))
    found = found.join(refs, ["path", "number"], "left").withColumns({"ref": F.coalesce("ref", F.lit("*")), "file": F.element_at(F.split("path", "/"), -1)})
    return found.select("file", "name", "flag", "ref", "pos", "mapq", "cigar", "seq", "qual")


# -- writing -----------------------------------------------------------------------------------------------


def _packed(refs: Sequence[tuple[str, int]]):
    number = {name: i for i, (name, _) in enumerate(refs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, n, held, out = None, 0, b"", []

        def closed() -> None:
            nonlocal n, held
            # A header or a record may need several blocks.
            for at in range(0, len(held), BLOCK):
                out.append((sample, n, deflated(held[at : at + BLOCK])))
                n += 1
            held = b""

        for batch in batches:
            for own, name, flag, ref, pos, mapq, cigar, seq, qual in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != sample:
                    closed()
                    sample, n, held = own, 0, header(refs)
                    closed()
                row = encoded(name, flag, -1 if ref == "*" else number[ref], pos, mapq, cigar, seq, qual)
                if len(held) + len(row) > BLOCK:
                    closed()
                held += row
            yield _blocks_of(out)
            out.clear()
        closed()
        yield _blocks_of(out)

    return run


def _blocks_of(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["sample", "n", "block"])


def write(reads: DataFrame, path: str, refs: Sequence[tuple[str, int]]) -> None:
    """reads (sample, name, flag, ref, pos, mapq, cigar, seq, qual) as sorted BAM files in a folder for each sample.

    refs are the references' names and lengths. A sample whose reads are many comes in several files, each with its
    header and in its range of places; a read of another reference stops the run. Spark's committer guards the files.
    """
    spark, order = reads.sparkSession, {name: i for i, (name, _) in enumerate(refs)}
    place = F.coalesce(*[F.when(F.col("ref") == name, F.lit(i)) for name, i in order.items()], F.lit(len(order)))
    rows = reads.select("sample", "name", F.col("flag").cast("int"), "ref", F.col("pos").cast("int"), F.col("mapq").cast("int"), "cigar", "seq", "qual").repartitionByRange("sample", place, "pos").sortWithinPartitions("sample", place, "pos", "name")
    blocks = rows.mapInArrow(_packed(refs), "sample string, n long, block binary").sortWithinPartitions("sample", "n")
    blocks.select("sample", F.col("block").cast("string").alias("value")).write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").partitionBy("sample").text(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(where):
        for f in files.listStatus(folder.getPath()) if folder.isDirectory() else ():
            name = f.getPath().getName()
            if name.endswith(".txt"):
                files.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder.getPath(), name[:-3] + "bam"))


def write_named(reads: DataFrame, wanted: DataFrame, path: str, refs: Sequence[tuple[str, int]]) -> None:
    """The reads with the wanted names (name) as BAM files. A name that no read has stops the run before anything is written."""
    missing = wanted.select("name").distinct().join(reads.select("name"), "name", "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"no read has the names {sorted(r.name for r in missing)}")
    write(reads.join(wanted.select("name").distinct(), "name", "left_semi"), path, refs)

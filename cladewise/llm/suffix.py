"""Long repeated passages by enhanced suffix arrays, sharded by content.

A byte is covered if a `least`-byte string that contains it also starts anywhere else. Each window of `least`
bytes is assigned to an anchor: the leftmost smallest hash of its `GRAM`-byte substrings. Equal windows have
equal anchors at equal places, so windows need only be compared within an anchor's group. An anchor's
occurrence stands for a run of window starts; the bytes of these windows are its context.

1. Anchors and context hashes are taken in one scan. Anchors that occur once are done. A context that occurs
   twice is covered as a whole. Only groups that hold several different contexts, not all repeated, go on,
   one copy of each context.
2. Their bytes are put into suffix arrays, many groups to a batch of bounded size: prefix doubling,
   longest common prefixes, then a stack scan of the common-prefix interval tree that tests the diversity of
   left extensions and yields each maximal repeat with all its occurrences. Intervals whose members all have
   one left neighbour are skipped before the scan: the interval one byte further left holds them.
3. A group with more than HOT different contexts never meets in one task: its windows are split by place
   into ever smaller blocks, and blocks are compared by hashes that are counted before they are shuffled.

Defined results: null text is empty; texts under `least` bytes have no spans; repeated rows are repeats of
each other; an empty table gives an empty result; clashing column names are kept by `remove`. The first
occurrence is removed like all others. `remove` drops a character if any of its bytes is covered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, Scratch, chunks, cut, mix64, staged, text_bytes

LEAST = 400
GRAM = 32
#: Different contexts that one group may have to be put into one suffix array.
HOT = 2048
#: Bytes of a suffix array, apart from its last group.
BATCH = 1 << 20
#: Window starts that one pass over a long text handles.
PIECE = 1 << 20
_PLACE_BITS = 24
_hash = Powers(61)
_INT, _LONG = pa.int32(), pa.int64()
_WORD = re.compile(rb"[^ \t-\r]+")


# -- enhanced suffix array ---------------------------------------------------------------------------------


class Repeats:
    """The enhanced suffix array of several byte strings, restricted to suffixes of `least` bytes or more."""

    def __init__(self, parts: list[bytes], least: int) -> None:
        self.least = least
        raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size)])
        n = len(raw)
        self.part = np.repeat(np.arange(len(parts)), size)
        self.remaining = self.begin[1:][self.part] - np.arange(n)
        self.raw = raw
        # Symbols of 9 bits, 0 past a string's end; 7 of them make the first ranks.
        key = np.zeros(n, np.uint64)
        for k in range(7):
            symbol = np.zeros(n, np.uint64)
            if n > k:
                symbol[: n - k] = np.where(self.remaining[: n - k] > k, raw[k:].astype(np.uint64) + np.uint64(1), 0)
            key |= symbol << np.uint64(9 * (6 - k))
        longest = int(size.max()) if len(size) else 0
        self.ranks: list[tuple[int, np.ndarray]] = []
        h = 7
        while n:
            rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
            self.ranks.append((h, rank))
            if h >= longest or h >= 1 << 30:
                break
            second = np.zeros(n, np.uint64)
            if n > h:
                second[: n - h] = np.where(self.remaining[: n - h] > h, rank[h:].astype(np.uint64) + np.uint64(1), 0)
            key = (rank.astype(np.uint64) << np.uint64(32)) | second
            h *= 2
        starts = np.flatnonzero(self.remaining >= least)
        self.array = starts[np.argsort(self.ranks[-1][1][starts], kind="stable")] if n else starts
        self.lcp = self._common(self.array[:-1], self.array[1:]) if len(self.array) else np.zeros(0, np.int64)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes by binary lifting over the ranks."""
        most = np.minimum(self.remaining[a], self.remaining[b])
        out, last = np.zeros(len(a), np.int64), len(self.raw) - 1
        for h, rank in reversed(self.ranks):
            fits = out + h <= most
            same = fits & (rank[np.minimum(a + out, last)] == rank[np.minimum(b + out, last)])
            out += h * same
        for _ in range(6):
            out += (out < most) & (self.raw[np.minimum(a + out, last)] == self.raw[np.minimum(b + out, last)])
        return out

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """Maximal repeats of `least` bytes or more: length, and the places of all occurrences in the joined strings."""
        n = len(self.array)
        if n < 2:
            return
        joined = self.lcp >= self.least
        left = np.where(self.array > self.begin[self.part[self.array]], self.raw[np.maximum(self.array - 1, 0)].astype(np.int64), -1)
        # Runs of neighbours with long common prefixes; those with one left neighbour throughout are skipped.
        run = np.concatenate([[0], np.cumsum(~joined)])
        edge = np.flatnonzero(np.concatenate([[True], ~joined, [True]]))
        low, high = np.minimum.reduceat(left, edge[:-1]), np.maximum.reduceat(left, edge[:-1])
        length = np.diff(edge)
        for r in np.flatnonzero((length > 1) & ((low != high) | (low < 0))):
            a, b = int(edge[r]), int(edge[r + 1])
            yield from self._scan(a, b, left)
        del run

    def _scan(self, a: int, b: int, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Stack scan of suffixes a..b-1. An entry: length, first suffix, left neighbours (bits; bit 256: at a string's start)."""
        bit = [1 << (int(x) if x >= 0 else 256) for x in left[a:b]]
        lcp = self.lcp[a : b - 1].tolist()
        stack: list[list[int]] = []
        for i in range(b - a):
            now = lcp[i] if i < b - a - 1 else 0
            first, seen = i, bit[i]
            while stack and stack[-1][0] > now:
                depth, first, before = stack.pop()
                seen |= before
                if seen & (seen - 1) or seen >> 256:
                    yield depth, self.array[a + first : a + i + 1]
            if now >= self.least:
                if stack and stack[-1][0] == now:
                    stack[-1][2] |= seen
                else:
                    stack.append([now, first, seen])

    def covered(self) -> list[np.ndarray]:
        """For each string the (from, to) ranges that its repeats cover."""
        step = np.zeros(len(self.raw) + 1, np.int64)
        for depth, places in self.groups():
            np.add.at(step, places, 1)
            np.add.at(step, places + depth, -1)
        inside = np.cumsum(step)[:-1] > 0
        out = []
        for k in range(len(self.begin) - 1):
            own = inside[self.begin[k] : self.begin[k + 1]]
            out.append(np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2))
        return out


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each maximal repeat of `least` bytes or more with all its occurrences (text, place)."""
    array = Repeats(texts, least)
    return [(bytes(array.raw[p[0] : p[0] + depth]), sorted((int(array.part[x]), int(x - array.begin[array.part[x]])) for x in p)) for depth, p in array.groups()]


# -- anchors -----------------------------------------------------------------------------------------------


def anchors(raw: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, anchor hash, context hash, first window start, anchor, last window start; places in raw."""
    n, wide = len(raw), least - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < least:
        return none
    prefix = _hash.prefix(raw)
    at = np.arange(n - gram + 1)
    grams = _hash.spans(prefix, at, at + gram)
    best = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= wide:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    best = np.minimum(best[: n - least + 1], best[wide - span : wide - span + n - least + 1])
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)[: n - least + 1]
    good = offsets[1:][row] - np.arange(n - least + 1) >= least
    place = (best & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = good.copy()
    new[1:] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~good[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    stop = good.copy()
    stop[:-1] &= new[1:] | ~good[1:]
    last = np.flatnonzero(stop)
    anchor = place[first]
    context = _hash.spans(prefix, first, last + least)
    return row[first], grams[anchor], mix64(context + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first, anchor, last


def _pieces(raw: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place within it, bytes, offsets): long texts in pieces whose windows together are all windows."""
    for a, b in chunks(offsets):
        own = raw[offsets[a] : offsets[b]]
        if len(own) <= PIECE + least:
            yield a, 0, own, offsets[a : b + 1] - offsets[a]
        else:
            for at in range(0, len(own) - least + 1, PIECE):
                piece = own[at : at + PIECE + least - 1]
                yield a, at, piece, np.array([0, len(piece)])


def _scan_anchors(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for first_row, place, own, at in _pieces(raw, offsets, least):
                row, anchor, context, lo, mid, hi = anchors(own, at, least, gram)
                base = at[row] - place
                take = pa.array(row + first_row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), *(pa.array((x - base).astype(np.int32)) for x in (lo, mid, hi))],
                    names=["id", "th", "anchor", "context", "lo", "mid", "hi"],
                )

    return run


def _cut_contexts(least: int):
    """text, wanted -> anchor, context, off, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            out: list[tuple] = []
            held = 0
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                for w in wanted:
                    out.append((w["anchor"], w["context"], w["mid"] - w["lo"], raw[offsets[i] + w["lo"] : offsets[i] + w["hi"] + least].tobytes()))
                    held += len(out[-1][3])
                    if held > 4 << 20:
                        yield _context_batch(out)
                        out, held = [], 0
            yield _context_batch(out)

    return run


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (_LONG, _LONG, _INT, pa.binary()), strict=True)], names=["anchor", "context", "off", "bytes"])


_RANGES = pa.list_(pa.struct([("from", _INT), ("to", _INT)]))


def _range_batch(keys: list[tuple[int, int]], ranges: list[np.ndarray]) -> pa.RecordBatch:
    rows = [[{"from": int(a), "to": int(b)} for a, b in r] for r in ranges]
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], _LONG), pa.array([k[1] for k in keys], _LONG), pa.array(rows, _RANGES)], names=["anchor", "context", "ranges"])


def _with_repeats(parts: list[bytes], least: int) -> list[int]:
    """The strings in which a hash of `least` bytes occurs that another place has as well: equal bytes have equal hashes, so no other string has a repeat."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    starts = np.maximum(size - least + 1, 0)
    at = np.repeat(np.cumsum(size) - size - np.cumsum(starts) + starts, starts) + np.arange(starts.sum())
    if not len(at):
        return []
    key = _hash.spans(_hash.prefix(raw), at, at + least)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    place = np.minimum(np.searchsorted(twice, key), max(0, len(twice) - 1))
    hit = twice[place] == key if len(twice) else np.zeros(len(key), bool)
    return np.unique(np.repeat(np.arange(len(parts)), starts)[hit]).tolist()


def _suffix_arrays(least: int):
    """Contexts in order of their anchor -> the ranges that repeats cover; several whole groups to an array."""

    def solved(keys: list[tuple[int, int]], parts: list[bytes]) -> pa.RecordBatch:
        some = _with_repeats(parts, least)
        keys, parts = [keys[k] for k in some], [parts[k] for k in some]
        found = [(k, r) for k, r in zip(keys, Repeats(parts, least).covered(), strict=True) if len(r)]
        return _range_batch([k for k, _ in found], [r for _, r in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        parts: list[bytes] = []
        held = 0
        for batch in batches:
            for anchor, context, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held >= BATCH and anchor != keys[-1][0]:
                    yield solved(keys, parts)
                    keys, parts, held = [], [], 0
                if not keys or keys[-1] != (anchor, context):
                    keys.append((anchor, context)), parts.append(data)
                    held += len(data)
        if keys:
            yield solved(keys, parts)

    return run


def _split_blocks(least: int, gram: int, step: int):
    """anchor, context, off, bytes, lo, hi -> blocks of `step` window starts: core, whole (hashes), a, b (starts within the context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = -(-(least - gram + 1) // 128) * 128
        for batch in batches:
            out: list[tuple] = []
            for anchor, context, off, data, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix = _hash.prefix(np.frombuffer(data, np.uint8))
                # Blocks lie on a grid that is counted from the anchor, so they are the same in all contexts.
                block = np.arange((lo - off + shift) // step, (hi - off + shift) // step + 1)
                start = block * step - shift + off
                a, b = np.maximum(start, lo), np.minimum(start + step - 1, hi)
                # What all windows of the block have in common lies in each context that has one of them.
                core = _hash.spans(prefix, start + step - 1, start + least).view(np.int64) if step <= least else np.zeros(len(start), np.int64)
                whole = mix64(_hash.spans(prefix, a, b + least) + (a - off + shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                out += [(anchor, context, *x) for x in zip(block.tolist(), core.tolist(), whole.tolist(), a.tolist(), b.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            names = ["anchor", "context", "block", "core", "whole", "lo", "hi"]
            yield pa.RecordBatch.from_arrays([pa.array(c, _INT if k in ("block", "lo", "hi") else _LONG) for k, c in zip(names, columns, strict=True)], names=names)

    return run


def _hot_ranges(hot: DataFrame, least: int, gram: int, scratch: Scratch) -> DataFrame:
    """The covered ranges of contexts in groups that are too large for one suffix array: anchor, context, off, bytes, n, last -> anchor, context, from, to."""
    hot = scratch.staged(hot, "hot")
    active = hot.select("anchor", "context", F.lit(0).alias("lo"), F.col("last").alias("hi"))
    found = None
    for step in (128, 32, 8, 2, 1):
        rows = hot.join(active, ["anchor", "context"]).select("anchor", "context", "off", "bytes", "lo", "hi")
        blocks = rows.mapInArrow(_split_blocks(least, gram, step), "anchor long, context long, block int, core long, whole long, lo int, hi int")
        blocks = cut(blocks.join(hot.select("anchor", "context", "n"), ["anchor", "context"]))
        # A core that no other context has: none of the block's windows is repeated here.
        alive = blocks.groupBy("anchor", "block", "core").agg(F.sum("n").alias("cores")).where("cores > 1")
        left = blocks.join(alive, ["anchor", "block", "core"])
        same = blocks.groupBy("anchor", "block", "whole").agg(F.sum("n").alias("wholes"), F.min("context").alias("one"))
        left = cut(left.join(same, ["anchor", "block", "whole"]))
        done = left.where((F.col("wholes") > 1) if step > 1 else F.lit(True)).select("anchor", "context", F.col("lo").alias("from"), (F.col("hi") + least).alias("to"))
        found = done if found is None else found.unionByName(done)
        # One of several equal blocks stays, for the parts of others that are equal to parts of it.
        active = left.where("context = one").select("anchor", "context", "lo", "hi")
    return found


# -- the operator ------------------------------------------------------------------------------------------


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Of docs (id, text, th = xxhash64(text)) those with covered bytes: id, th, ranges (may overlap)."""
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    seen = scratch.staged(docs.select("id", "th", "text").mapInArrow(_scan_anchors(least, gram), f"id {kind}, th long, anchor long, context long, lo int, mid int, hi int"), "anchors")
    contexts = seen.groupBy("anchor", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "th", "lo", "mid", "hi")))
    contexts = scratch.staged(contexts, "contexts")
    groups = contexts.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"), F.min("n").alias("least_n")).where("all_n > 1").drop("all_n")
    live = scratch.staged(contexts.join(groups, "anchor"), "live")

    whole = live.where("n > 1").select("anchor", "context", F.array(F.struct(F.lit(0).alias("from"), (F.col("hi") - F.col("lo") + least).alias("to"))).alias("ranges"))
    wanted = live.where("m > 1 and least_n = 1").groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "context", "lo", "mid", "hi")).alias("wanted"))
    text = docs.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "text")
    held = text.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))).select("text", "wanted")
    held = held.mapInArrow(_cut_contexts(least), "anchor long, context long, off int, bytes binary")
    held = scratch.staged(held.join(live.select("anchor", "context", "n", "m", (F.col("hi") - F.col("lo")).alias("last")), ["anchor", "context"]), "held")

    small = held.where(F.col("m") <= hot).select("anchor", "context", "bytes").repartition("anchor").sortWithinPartitions("anchor", "context")
    pair = "anchor long, context long, ranges array<struct<from:int,to:int>>"
    found = small.mapInArrow(_suffix_arrays(least), pair)
    large = held.where(F.col("m") > hot).dropDuplicates(["anchor", "context"])
    if large.limit(1).count():
        ranges = _hot_ranges(large, least, gram, scratch).groupBy("anchor", "context").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
        found = found.unionByName(ranges)
    covered = whole.unionByName(found.join(live.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_anti"))
    hits = seen.select("id", "th", "anchor", "context", "lo").join(covered, ["anchor", "context"])
    moved = F.transform("ranges", lambda r: F.struct((r["from"] + F.col("lo")).alias("from"), (r["to"] + F.col("lo")).alias("to")))
    # Equal rows have equal ranges: each list is told once. Lists stay whole, so a common passage makes no more rows than its documents have anchors.
    out = staged(hits.select("id", "th", moved.alias("r")).groupBy("id", "th").agg(F.flatten(F.collect_set("r")).alias("ranges")), "spans")
    scratch.drop()
    return out


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[list[int]] = []
    for a, b in sorted((r["from"], r["to"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """row (docs' columns as a struct), text (null as empty) and ranges (null if none)."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = whole.withColumn("th", F.xxhash64("text"))
    found = spans(whole.select("id", "text", "th"), **options).withColumnRenamed("id", "_id").withColumnRenamed("th", "_th")
    return whole.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("row", "id", "text", "ranges")


def _with_runs(least: int):
    """Rows of which some run of the ranges has `least` bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([i for i, r in enumerate(batch.column(2).to_pylist()) if any(b - a >= least for a, b in merged(r))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own)], names=["id", "th"])

    return run


def marked_twice(docs: DataFrame, passage: int, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, **options) -> DataFrame:
    """row, id, text (null as empty), ranges by `least` bytes, and passages: ranges by `passage` bytes, of which there are fewer in a string. Only documents with runs of `least` bytes by the smaller threshold are searched again."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = whole.withColumn("th", F.xxhash64("text"))
    own, both = whole.select("id", "text", "th"), lambda x: F.col("id").eqNullSafe(x._id) & (F.col("th") == x._th)
    named = lambda x, name: x.select(F.col("id").alias("_id"), F.col("th").alias("_th"), *([F.col("ranges").alias(name)] if name else []))
    short = spans(own, passage, **options)
    kind = docs.schema[id_col].dataType.simpleString()
    some = named(cut(short.mapInArrow(_with_runs(least), f"id {kind}, th long")), "")
    long = named(spans(own.join(some, both(some), "left_semi"), least, **options), "ranges")
    short = named(short, "passages")
    return whole.join(long, both(long), "left").drop("_id", "_th").join(short, both(short), "left").select("row", "id", "text", "ranges", "passages")


def without_passages(text: bytes, ranges: list[dict] | None, words: int) -> str:
    """The text without those runs of covered characters in which `words` words or more begin."""
    runs = [x for x in merged(ranges) if len(_WORD.findall(text, *x)) >= words]
    return kept_bytes(text, whole_characters(text, runs)).decode()


def kept_bytes(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges widened to characters, so that what stays is UTF-8."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        while a > 0 and a < len(text) and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
    return merged([{"from": a, "to": b} for a, b in out])


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 0, **options) -> DataFrame:
    """docs with the covered characters taken out of the text; a document that loses nothing keeps its text, null included. Runs of covered bytes in which fewer than `words` words begin stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(1), batch.column(2).to_pylist()
            out = []
            for i, r in enumerate(ranges):
                if r:
                    out.append(without_passages(texts[i].as_py().encode(), r, words))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "left"])

    found = marked(docs, id_col, text_col, **options).select("row", "text", "ranges")
    kind = found.schema["row"].dataType.simpleString()
    out = found.mapInArrow(run, f"row {kind}, left string")
    return out.select(*[(F.coalesce("left", F.col(f"row.`{c}`")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

"""b-bit MinHash near-duplicates of word shingles, with exact links and components.

Each distinct shingle set is one class, so copies cost one row. Bands of the full minima give candidate
buckets; packed low bits of the minima give a collision-corrected estimate by bit counts; what passes it is
confirmed on full sets. Buckets are never expanded into pairs: every member meets the bucket's first member and
confirmed links are contracted; where much is left, members meet other first members in further rounds. Of the buckets
that still hold several components, large ones are split into narrower ones by further minima. What is left is
compared in blocks of bounded size inside tasks, which hold the blocks' full sets: a pair is counted only if it is across components, if its estimate is high enough and if what
the two share with anyone in the blocks can suffice; a task gives out only the links that join components.

Defined results: null or wordless text has an empty set and is linked with nothing; fewer words than the
shingle length make one shingle of the whole sequence; repeated rows each get a row; an empty table gives an
empty result; columns other than the id and the text are ignored. A null id never names a component unless
all ids of the component are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, Scratch, chunks, cut, cut_small, mix64, partitions, random_words, staged, text_bytes

WORDS = 5
LEAST_PERCENT = 75
#: A pair as similar as the threshold shares no band with probability (1 - 0.75**4)**32, 5 in a million.
BANDS, ROWS = 32, 4
#: Minima behind the estimate; the first BANDS * ROWS of them make the bands.
PERMUTATIONS = 512
BITS = 4
#: Standard deviations of the estimate that a pair may lie under the threshold and still be confirmed on full sets.
SLACK = 5.0
#: Members of a block of a bucket, and the shingles that a block has about.
BLOCK, BLOCK_SHINGLES = 4096, 2 << 20
#: Rounds of other first members, as long as the pairs that are left are more than MUCH times the classes.
ROUNDS, MUCH = 2, 64

_PERMS = PERMUTATIONS
_MULTIPLY = random_words(11, _PERMS).astype(np.uint32) | np.uint32(1)
_ADD = random_words(12, _PERMS).astype(np.uint32)
_BAND = random_words(13, ROWS) | np.uint64(1)
_PLACE = random_words(14, WORDS) | np.uint64(1)
_hash = Powers(15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each row its distinct shingle hashes, ascending."""
    raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    n, rows = len(raw), len(offsets) - 1
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets[:-1][offsets[:-1] < n]] = inside[offsets[:-1][offsets[:-1] < n]]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = _hash.spans(_hash.prefix(raw), start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words if len(rolled) else 0):
        rolled += hashes[k : k + len(rolled)] * _PLACE[k]
    rolled = mix64(rolled)
    out = []
    for i in range(rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.uint64((b - a) * 0x9E3779B97F4A7C15 % (1 << 64))
            for k in range(b - a):
                short = mix64(np.array([short ^ hashes[a + k]], np.uint64))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray, step: int = 1024) -> np.ndarray:
    """The minima under all permutations."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(_PERMS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), step):
        np.minimum(out, (low[None, at : at + step] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def packed(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    per = 64 // bits
    low = (mins & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(-1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1)


def set_key(shingles: np.ndarray) -> bytes:
    """Names a shingle set by its content."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keys, signs, bands = [], [], []
            for s in sets:
                if not len(s):
                    keys.append(None), signs.append(None), bands.append(None)
                    continue
                m = minima(s)
                keys.append(set_key(s))
                signs.append(packed(m).view(np.int64))
                grouped = mix64((m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
                bands.append(grouped.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, longs), pa.array(bands, longs)],
                names=["id", "th", "n_shingles", "key", "sign", "bands"],
            )


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), n_shingles, key (names the set; null if empty), sign (packed low bits), bands (hashes of bands of minima)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    return rows.mapInArrow(_sketches, f"id {kind}, th long, n_shingles long, key binary, sign array<long>, bands array<long>")


def estimate(a: F.Column, b: F.Column, bits: int = BITS) -> F.Column:
    """Similarity from packed signatures: equal lanes by bit counts, corrected for chance collisions."""
    ones = sum(1 << k for k in range(0, 64, bits))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def differing(x: F.Column, y: F.Column) -> F.Column:
        d = x.bitwiseXOR(y)
        for k in range(bits.bit_length() - 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, 1 << k))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    total = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << bits)
    return (1 - total / F.lit(_PERMS) - chance) / (1 - chance)


def least_estimate(percent: int = LEAST_PERCENT, bits: int = BITS) -> float:
    chance = 1.0 / (1 << bits)
    p = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - SLACK * (p * (1 - p) / _PERMS) ** 0.5 / (1 - chance)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key, shingles; rows of another text under the same id are dropped by their key."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        keys = batch.column(0).to_pylist()
        for a, b in chunks(offsets):
            sets = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            own = [i for i, s in enumerate(sets) if len(s) and set_key(s) == keys[a + i]]
            yield pa.RecordBatch.from_arrays([pa.array([keys[a + i] for i in own], pa.binary()), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["key", "shingles"])


def full_sets(keys: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """key and shingles of the classes in keys, from one of their documents each; texts are shuffled once."""
    holders = classes.join(keys.distinct(), "key").select("key", "class_id", F.col("th").alias("of"))
    texts = docs.select(F.col("id").alias("doc"), "text", F.xxhash64("text").alias("th"))
    full = texts.join(holders, texts.doc.eqNullSafe(holders.class_id) & (texts.th == holders.of)).select("key", "text").mapInArrow(_sets, "key binary, shingles array<long>")
    # A row that the input repeats gives its set more than once.
    return full.dropDuplicates(["key"])


def confirmed(pairs: DataFrame, full: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """Of pairs (a, b) of keys those whose full sets are similar enough."""
    both = (
        pairs.join(full.select(F.col("key").alias("b"), F.col("shingles").alias("of_b")), "b")
        .join(full.select(F.col("key").alias("a"), F.col("shingles").alias("of_a")), "a")
        .select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("same"), (F.size("of_a") + F.size("of_b")).cast("long").alias("sizes"))
    )
    return both.where(100 * F.col("same") >= percent * (F.col("sizes") - F.col("same"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (node, label): label is the least node that can be reached; nodes without links are absent.

    Alternating large-star and small-star steps; every step is a grouped minimum and a join, so no node's
    neighbours ever meet in one task's memory.
    """
    edges = cut_small(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before, n = None, partitions(edges.count())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # One pass over both directions: larger neighbours, and the node itself, hang on the least one.
        large = both.join(least, "a").select(F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.coalesce(n).distinct().coalesce(n)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").coalesce(n).distinct().coalesce(n))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            own = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
            return own.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()).coalesce(2 * n)
        before = now


class _Group:
    """Members of one bucket, of one block or two, that meet in a task."""

    def __init__(self, labels: list[bytes], block: np.ndarray, signs: np.ndarray, sets: np.ndarray, offsets: np.ndarray, across: bool) -> None:
        number = {c: i for i, c in enumerate(dict.fromkeys(labels))}
        self.part = np.array([number[c] for c in labels])
        self.block, self.signs, self.offsets, self.across = block, signs, offsets, across
        self.size = np.diff(offsets)
        _, self.dense, count = np.unique(sets, return_inverse=True, return_counts=True)
        # Shingles that no other member has cannot be shared.
        shared = np.concatenate([[0], np.cumsum(count[self.dense] > 1)])
        self.most = shared[offsets[1:]] - shared[offsets[:-1]]
        self.flag = np.zeros(len(count), bool)

    def _same(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles of i each of others has."""
        own = self.dense[self.offsets[i] : self.offsets[i + 1]]
        self.flag[own] = True
        n = self.size[others]
        edge = np.concatenate([[0], np.cumsum(n)])
        hit = self.flag[self.dense[np.repeat(self.offsets[others] - edge[:-1], n) + np.arange(edge[-1])]]
        self.flag[own] = False
        return np.add.reduceat(hit.astype(np.int64), edge[:-1])

    def links(self, percent: int = LEAST_PERCENT, step: int = 256) -> Iterator[tuple[int, int]]:
        """Confirmed pairs, each of which joins two components."""
        least, chance = least_estimate(percent), 1.0 / (1 << BITS)
        ones = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
        enough = lambda i, j, same: 100 * same >= percent * (self.size[i] + self.size[j] - same)
        first = np.flatnonzero(self.block == self.block.min()) if self.across else np.arange(len(self.part))
        for i in first.tolist():
            others = self.part != self.part[i]
            others[: i + 1] &= self.across
            others &= (self.block != self.block[i]) | (not self.across)
            others = np.flatnonzero(others)
            others = others[enough(i, others, np.minimum(self.most[i], self.most[others]))]
            if not len(others):
                continue
            d = self.signs[others] ^ self.signs[i]
            for k in range(BITS.bit_length() - 1):
                d = d | (d >> np.uint64(1 << k))
            share = (1 - np.bitwise_count(d & ones).sum(axis=1) / _PERMS - chance) / (1 - chance)
            likely = share >= least
            others = others[likely][np.argsort(-share[likely], kind="stable")]
            while len(others):
                now, others = others[:step], others[step:]
                for j in now[enough(i, now, self._same(i, now))].tolist():
                    if self.part[j] != self.part[i]:
                        self.part[self.part == self.part[j]] = self.part[i]
                        yield i, j
                others = others[self.part[others] != self.part[i]]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of slot, x, y: slot, x, y, block, key, label, sign, shingles -> links."""
    held: list[pa.RecordBatch] = []

    def solved() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys, sets, signs = rows.column(4), rows.column(7), rows.column(6)
        group = _Group(rows.column(5).to_pylist(), rows.column(3).to_numpy(), signs.flatten().to_numpy().view(np.uint64).reshape(len(keys), -1), sets.flatten().to_numpy(), sets.offsets.to_numpy().astype(np.int64) - sets.offsets[0].as_py(), rows.column(1)[0] != rows.column(2)[0])
        found = [sorted((keys[i].as_py(), keys[j].as_py())) for i, j in group.links()]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch.column(k).to_numpy() for k in range(3)])
        edges = np.flatnonzero(np.concatenate([[True], (where[:, 1:] != where[:, :-1]).any(axis=0), [True]])).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            if held and last != tuple(where[:, a].tolist()):
                yield solved()
                held.clear()
            last = tuple(where[:, a].tolist())
            held.append(batch.slice(a, b - a))
    if held:
        yield solved()


#: Low bits of so many minima make a narrower bucket; a word of a signature has so many of these.
NARROW, NARROW_OF_WORD = 5, 3


def narrowed(filled: DataFrame, label: DataFrame, classes: DataFrame) -> DataFrame:
    """filled (slot, key), with each bucket of more than BLOCK members and several components split into narrower ones.

    A narrower bucket asks for the same low bits of NARROW further minima: of 96 such, a pair at the threshold shares
    none with probability 2 in 10**13. So a member of a hot bucket makes 96 rows at most, however large the bucket
    is, and of these only those stay that meet another component.
    """
    labelled = filled.select("slot", "key").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = labelled.groupBy("slot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    rows = labelled.join(mixed.select("slot", "size"), "slot")
    large = rows.where(F.col("size") > BLOCK).join(classes.select("key", "sign"), "key")
    width = NARROW * BITS
    parts = F.flatten(F.transform("sign", lambda v, i: F.array(*[F.xxhash64("slot", i, F.lit(k), F.shiftrightunsigned(v, k * width).bitwiseAND(F.lit((1 << width) - 1))) for k in range(NARROW_OF_WORD)])))
    large = large.select("key", "label", F.explode(parts).alias("slot"))
    met = large.groupBy("slot").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    large = large.join(met.select("slot"), "slot", "left_semi")
    return rows.where(F.col("size") <= BLOCK).select("slot", "key").unionByName(large.select("slot", "key"))


def _compared_in_tasks(filled: DataFrame, label: DataFrame, classes: DataFrame, full: DataFrame) -> DataFrame:
    """Links that join the components that are left in any bucket."""
    member = filled.select("slot", "key").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    member = member.join(classes.select("key", "sign", F.col("n_shingles").alias("_n")), "key")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("_n") / BLOCK_SHINGLES)).cast("int")
    mixed = member.groupBy("slot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), blocks.alias("blocks")).where("lo <> hi")
    member = member.join(mixed.select("slot", "blocks"), "slot").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("_n")
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = member.join(full, "key").select("slot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "key", "label", "sign", "shingles")
    rows = rows.repartition("slot", "x", "y").sortWithinPartitions("slot", "x", "y", "key")
    return rows.mapInArrow(_compared, "a binary, b binary").distinct()


def _linked(filled: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Confirmed links that connect what any chain of confirmed links within buckets connects, and their components."""
    sign = classes.select("key", "sign")

    def likely(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(sign.select(F.col("key").alias("b"), F.col("sign").alias("of_b")), "b").join(sign.select(F.col("key").alias("a"), F.col("sign").alias("of_a")), "a")
        return both.where(estimate(F.col("of_a"), F.col("of_b")) >= least_estimate()).select("a", "b")

    full = scratch.staged(full_sets(filled.select("key"), docs, classes), "sets")
    tested = cut_small(likely(filled.where("hub <> key").select(F.col("hub").alias("a"), F.col("key").alias("b"))))
    links = cut_small(confirmed(tested, full))
    label = cut_small(components(links))
    most = classes.count()
    filled = filled.where("n > 2")  # a bucket of two is done; in the others, several components may be left
    for turn in range(ROUNDS + 1):
        member = filled.select("slot", "key").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        first = F.min_by("key", F.xxhash64("key", F.lit(turn)))
        mixed = cut_small(member.groupBy("slot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), first.alias("first")).where("lo <> hi"))
        work = mixed.agg(F.sum(F.col("size") * F.col("size") / 2)).first()[0] or 0
        # Buckets only ever get fewer components, so their members and sets are all that later steps need.
        filled = cut_small(filled.join(mixed.select("slot"), "slot", "left_semi"))
        before, full = full, scratch.staged(full.join(filled.select("key").distinct(), "key", "left_semi").coalesce(partitions(filled.count())), "sets")
        scratch.drop(before)
        if work <= MUCH * most or turn == ROUNDS:
            break
        own = member.join(mixed.select("slot", "first"), "slot")
        of_first = label.select(F.col("node").alias("first"), F.col("label").alias("other"))
        own = own.join(of_first, "first", "left").where(F.col("label") != F.coalesce("other", "first"))
        new = cut_small(likely(own.select(F.col("first").alias("a"), F.col("key").alias("b"))).join(tested, ["a", "b"], "left_anti"))
        found = cut_small(confirmed(new, full))
        tested = tested.unionByName(new)
        if found.limit(1).count():
            links = links.unionByName(found)
            label = cut_small(components(links))
    if work:
        filled = cut_small(narrowed(filled, label, classes))
        found = cut_small(_compared_in_tasks(filled, label, classes, full))
        if found.limit(1).count():
            links = links.unionByName(found)
            label = cut_small(components(links))
    scratch.drop(full)
    return links, label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id that can be reached), kept, n_links (of the links used to join its component, those of its class; others are not sought once a component is joined)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.staged(sketch(docs, "id"), "sketch")
    # A class is held by the document of its least id; the text's hash tells it from others of that id.
    holder = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th"))
    classes = sketches.where("key is not null").groupBy("key").agg(holder.alias("holder"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    classes = scratch.staged(classes.select("key", F.col("holder.id").alias("class_id"), F.col("holder.th").alias("th"), "n_shingles", "sign", "bands"), "classes")
    slots = classes.select("key", F.explode("bands").alias("slot"))
    buckets = slots.groupBy("slot").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1")
    filled = scratch.staged(slots.join(buckets, "slot"), "buckets")

    links, label = _linked(filled, classes, docs, scratch)

    named = classes.select("key", "class_id").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    named = named.join(least, "label").join(degree, "key", "left").select("key", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sketches.select("id", "n_shingles", "key").join(named, "key", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = staged(out, "near")
    scratch.drop()
    return out

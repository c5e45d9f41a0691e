"""Importance resampling towards a target distribution, by hashed word runs.

Words and their buckets come from the UTF-8 bytes of Arrow buffers, many at a time: a table tells which bytes
belong to words (and lower-cases A-Z), differences of that tell where words begin and end, and the table-driven
checksums of all words move on by one byte together, the longest words first, so that those still running are
a prefix. `fit` counts buckets in each task and adds up a row for each bucket; the gains of all buckets are one
array of the model's size. `weigh` gives each document the floored mean of its features' gains, and `draw` adds
Gumbel noise from a hash of the id and takes the highest scores. Ranks come from ranges of (score, id), never from one
task, and only rows that the counts by score leave in question are sorted.

Defined results: null, empty and wordless texts have no features and weight 0; repeated rows count each for itself,
share one score and get ranks that follow each other; a null id scores as an empty one and comes after others in
ties; very long texts and words are taken whole; an empty table gives an empty result; columns other than id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, staged, text_bytes

BUCKETS = 10_000
RUN = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes of text handled together.
PIECE = 4 << 20
#: Bytes of a word that are handled together with other words; what follows is handled word by word.
TOGETHER = 64

_CODES = np.arange(256, dtype=np.uint8)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8)
IN_WORD = _UPPER | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and how many each row has."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = IN_WORD[raw]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    # Rows touch each other in the buffer, words of two rows don't.
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    before = edges[1:] - 1
    last[before] = inside[before]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.diff(np.searchsorted(begin, offsets))


def advance(state: np.ndarray, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The checksums' states after the bytes raw[begin : begin + size], all at once."""
    short = np.minimum(size, TOGETHER + 1)
    order = np.argsort(-short.astype(np.int8), kind="stable")
    at, c, short = begin[order], state[order], -short[order]
    # The longest come first: so many have a byte at k.
    for k, n in enumerate(np.searchsorted(short, -np.arange(-int(short[0]) if len(short) else 0), side="left")[:TOGETHER].tolist()):
        c[:n] = CRC[(c[:n] ^ raw[at[:n] + k]) & 255] ^ (c[:n] >> 8)
    for i in range(int(np.searchsorted(short, -TOGETHER, side="left"))):
        rest = raw[at[i] + TOGETHER : at[i] + size[order[i]]]
        c[i] = zlib.crc32(rest.tobytes(), int(c[i] ^ _ALL)) ^ int(_ALL)
    out = np.empty_like(c)
    out[order] = c
    return out


def features(raw: np.ndarray, offsets: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many words each row has; and for runs of 1, 2, ... words, how many each row has and their buckets, row by row."""
    raw = LOWER[raw]
    begin, end, n_words = words(raw, offsets)
    row, size, found = np.repeat(np.arange(len(n_words)), n_words), end - begin, []
    state = np.full(len(begin), _ALL)
    for n in range(1, run + 1):
        starts = max(0, len(row) - n + 1)
        state = state[:starts]
        if n > 1:
            state = CRC[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        # Runs that reach into the next row are none, and longer ones from the same place neither.
        whole = row[n - 1 :] == row[:starts]
        state = advance(state, raw, begin[n - 1 :], size[n - 1 :])
        found.append((np.bincount(row[:starts][whole], minlength=len(n_words)), ((state[whole] ^ _ALL) % np.uint32(buckets)).astype(np.int64)))
    return n_words, found


def _counts(run: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets, PIECE):
                for _, bucket in features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], run, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return count


def counts(docs: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: of all features of all rows. Each task gives one row for a bucket at most."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_counts(run, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: how much likelier its features are in the target than in docs, as a whole number of thousandths. What the driver gets is an array of `buckets` numbers."""
    both = []
    for side in (docs, target):
        held = np.zeros(buckets)
        for r in counts(side, text_col, run, buckets).collect():
            held[r.bucket] = r.n
        both.append(held)
    raw, goal = both
    return np.floor(1000 * np.log((goal + 1) * (raw.sum() + buckets) / ((raw + 1) * (goal.sum() + buckets)))).astype(np.int64)


def _weights(gains: np.ndarray, run: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            out = []
            for a, b in chunks(offsets, PIECE):
                n_words, found = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], run, len(gains))
                n, total = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for per_row, bucket in found:
                    upto = np.concatenate([[0], np.cumsum(gains[bucket])])[np.concatenate([[0], np.cumsum(per_row)])]
                    n, total = n + per_row, total + np.diff(upto)
                out.append((n_words, n, total // np.maximum(n, 1)))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
            places = (np.int64(part) << 40) + place + np.arange(batch.num_rows)
            place += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(places)], names=["id", "n_words", "n_features", "weight", "place"])

    return weigh


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """id, n_words, n_features, weight, and place: a number of the row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType(rows.schema.fields[:1])
    for name in ("n_words", "n_features", "weight", "place"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(_weights(gains, run), schema)


def noise(seed: int, name: str = "id"):
    """Thousandths of a Gumbel variable from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        more = [pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(np.arange(n + 1, n + 1 + batch.num_rows))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_part", "_n"])
        n += batch.num_rows


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with their rank in the given order: ranges are sorted each in its task, and the sizes of earlier ranges are added."""
    held = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, StructType([*rows.schema.fields]).add("_part", "long").add("_n", "long")), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_part").agg(F.max("_n").alias("size")).select("_part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_before"))
    return held.join(sizes, "_part").withColumn("rank", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def draw(weighed: DataFrame, percent: float = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score and rank: of the N rows with enough words, the floor(percent * N / 100) highest scores get ranks from 1."""
    rows = staged(weighed.withColumn("score", F.col("weight") + noise(seed)), "importance")
    enough = F.col("n_words") >= least_words
    # One row for each value of a score: what one task orders here is bounded by the span of gains and noise.
    by_score = rows.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    n = by_score.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    take = int(percent * n // 100)
    reached = by_score.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") - F.col("n") < take)
    least = reached.agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select("*", none)
    asked = enough & (F.col("score") >= least)
    best = ranked(rows.where(asked), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("place").asc())
    best = best.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return rows.where(~asked).select("*", none).unionByName(best)


#: The same in DuckDB's SQL, of the query's parameters. Checksums go byte by byte over distinct words.
ORACLE = """
WITH RECURSIVE bits(i, k, c) AS (
    SELECT i, 0, i FROM (SELECT unnest(range(0, 256)) AS i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
doc_words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
item_words AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
crc(w, h, k, c) AS (
    SELECT w, hex(w), 0, 4294967295 FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words)
    UNION ALL
    SELECT w, h, k + 1, xor(c // 256, t[1 + xor(c % 256, 16 * (instr('0123456789ABCDEF', substr(h, 2 * k + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * k + 2, 1)) - 1)])
    FROM crc, crc_table WHERE 2 * k < length(h)),
bucket AS (SELECT w, xor(c, 4294967295) % 10000 AS b FROM crc WHERE 2 * k = length(h)),
raw AS (SELECT b, count(*) AS n FROM doc_words JOIN bucket USING (w) GROUP BY b),
goal AS (SELECT b, count(*) AS n FROM item_words JOIN bucket USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(goal.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM raw) + 10000)::DOUBLE / ((coalesce(raw.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM goal) + 10000)::DOUBLE))) AS BIGINT) AS g
    FROM raw FULL JOIN goal USING (b)),
sums AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM doc_words JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
hashed AS (SELECT doc_id, sha256('2024:' || doc_id::VARCHAR) AS x FROM documents),
noisy AS (SELECT doc_id, list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', substr(x, i::BIGINT, 1)) - 1) * (16 ** (8 - i))))::DOUBLE AS h FROM hashed),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM documents d LEFT JOIN sums USING (doc_id) JOIN noisy ON noisy.doc_id = d.doc_id),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
    CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN CAST(place AS BIGINT) END AS rank
FROM placed
"""

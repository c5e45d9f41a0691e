"""Bradley-Terry quality scores: weights of text features are learnt from preference pairs.

Training: from a bounded sample of labelled rows (TRAIN_ROWS, by hash of the id) preference pairs (a good
document is preferred to a bad one) are formed; the logistic loss of w . (x_good - x_bad) is minimised by
Newton steps on the driver, so what is collected is bounded by TRAIN_ROWS however large the corpus is.
The threshold is a quantile of the sample's scores; a score is the logistic function of the distance to it.

Defined results: null text counts as empty, and an empty text has the score of its (constant) features; equal
texts have equal scores; labels that are null are not learnt from, several labels of one id count as their
mean (a tie counts as good); without both kinds of label all weights are 0 and every score is 0.5; an empty
table gives an empty result; columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, chunks, mix64, random_words, text_bytes

#: At most so many labelled rows are learnt from.
TRAIN_ROWS = 20_000
#: Preference pairs for each labelled row.
PAIRS = 12
RIDGE = 1e-3

_KINDS = ("upper", "lower", "digit", "blank", "newline", "bar", "stop", "shout", "quote", "symbol", "wide", "control")
_KIND = np.full(256, _KINDS.index("control"), np.uint8)
for _name, _bytes in (
    ("upper", range(65, 91)),
    ("lower", range(97, 123)),
    ("digit", range(48, 58)),
    ("blank", b" \t"),
    ("newline", b"\n\r"),
    ("bar", b"|"),
    ("stop", b".,;:"),
    ("shout", b"!?"),
    ("quote", b"'\"()[]{}-"),
    ("symbol", b"#$%&*@^~_+=<>/\\`"),
    ("wide", range(128, 256)),
):
    _KIND[list(_bytes)] = _KINDS.index(_name)
FEATURES = (
    "log_words", *(f"share_{k}" for k in _KINDS), "word_length", "word_spread", "capital_words", "symbol_words", "repeated_words", "distinct_words",
    "distinct_runs", "distinct_lines", "line_words", "entropy", "long_words", "short_words",
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_hash = Powers(31)
_PLACE = random_words(32, 5) | np.uint64(1)


def _distinct(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row."""
    own = np.sort((row.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    return np.bincount((own[first] >> np.uint64(40)).astype(np.int64), minlength=rows)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    rows, n = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(rows), n)
    size = np.maximum(n, 1)
    kinds = np.bincount(row * len(_KINDS) + _KIND[raw], minlength=rows * len(_KINDS)).reshape(rows, -1) / size[:, None]
    share = np.bincount(row * 256 + raw, minlength=rows * 256).reshape(rows, 256) / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = inside & np.concatenate([[True], ~inside[:-1]]) | inside & edge[:-1] if len(raw) else inside
    ends = inside & (np.concatenate([~inside[1:], [True]]) | edge[1:]) if len(raw) else inside
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    own, length = row[start], end - start
    words = np.bincount(own, minlength=rows)
    count = np.maximum(words, 1)
    total = lambda x: np.bincount(own, weights=x, minlength=rows)
    prefix = _hash.prefix(raw)
    key = _hash.spans(prefix, start, end)
    mean = total(length) / count
    spread = np.sqrt(np.maximum(total(length.astype(float) ** 2) / count - mean**2, 0))
    same = np.zeros(len(start))
    same[1:] = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
    runs = np.zeros(max(0, len(key) - 4), np.uint64)
    for k in range(5 if len(runs) else 0):
        runs += key[k : k + len(runs)] * _PLACE[k]
    whole = own[: len(runs)] == own[4:] if len(runs) else np.zeros(0, bool)
    run_row = own[: len(runs)][whole]
    run_count = np.maximum(np.bincount(run_row, minlength=rows), 1)

    breaks = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([offsets[:-1][n > 0], breaks + 1]))
    line_start = line_start[line_start < len(raw)]
    line_end = np.concatenate([line_start[1:], [len(raw)]]).astype(np.int64) if len(line_start) else line_start
    line_row = row[line_start]
    lines = np.maximum(np.bincount(line_row, minlength=rows), 1)
    # The newline that ends a line is not part of it.
    line_end = line_end - (raw[line_end - 1] == 10)
    line_key = _hash.spans(prefix, line_start, line_end)

    return np.column_stack([
        np.log1p(words), kinds, mean, spread, total(_KIND[raw[start]] == 0) / count, total(_KIND[raw[end - 1]] == _KINDS.index("symbol")) / count, total(same) / count,
        _distinct(own, key, rows) / count, np.where(np.bincount(run_row, minlength=rows) > 0, _distinct(run_row, mix64(runs[whole]), rows) / run_count, 1.0), _distinct(line_row, line_key, rows) / lines,
        np.log1p(words / lines), entropy, total(length > 15) / count, total(length < 3) / count,
    ])


@dataclass(frozen=True)
class Ranker:
    """score = logistic(weights . x - cut), x scaled, bent and clipped as in training."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def bent(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, z**2 / 6, np.abs(z)])

    def score(self, x: np.ndarray) -> np.ndarray:
        # A sum by row: a matrix product may round equal rows differently.
        return 1 / (1 + np.exp(-np.clip((self.bent(x) * self.weights).sum(axis=1) - self.cut, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranker:
    """Bradley-Terry: P(good preferred to bad) = logistic(w . (x_good - x_bad))."""
    d = len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(3 * d), 0.0)
    half = lambda v: (v[good].mean(axis=0) + v[bad].mean(axis=0)) / 2
    mean = half(x)
    start = Ranker(mean, np.sqrt(half((x - mean) ** 2)) + 1e-9, np.zeros(3 * d), 0.0)
    z = start.bent(x)
    rng, n = np.random.default_rng(seed), PAIRS * max(len(good), len(bad))
    # Every document takes part: both lists are repeated, then shuffled against each other.
    diff = z[rng.permutation(np.resize(good, n))] - z[rng.permutation(np.resize(bad, n))]
    w = np.zeros(3 * d)
    loss = lambda v: np.logaddexp(0, -(diff @ v)).mean() + RIDGE / 2 * v @ v
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        gradient = -(diff * p[:, None]).mean(axis=0) + RIDGE * w
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(3 * d), gradient)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    s = z @ w
    cuts = np.quantile(s, np.linspace(0, 1, 401))
    right = [((s >= c) == (y == 1)).mean() for c in cuts]
    best = np.flatnonzero(np.array(right) == max(right))
    return Ranker(start.mean, start.scale, w, float(cuts[best[len(best) // 2]]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            x = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Ranker:
    """Learns from at most `most` labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = known.groupBy(F.col(id_col).alias("label_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    # The sample is bounded by `most` rows of two numbers; ids that repeat in docs are bounded again below.
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id").select("label", "text").mapInArrow(_featured, "label double, x array<double>")
    found = rows.orderBy(F.xxhash64("x"), "label").limit(2 * most).collect()
    return fit_pairs(np.array([r.x for r in found], float).reshape(-1, len(FEATURES)), np.array([r.label for r in found]))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id (a struct may stand for a whole row) with score and predicted; one scan, no shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            values = [ranker.score(features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in chunks(offsets)]
            s = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("id")).mapInArrow(scored, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)

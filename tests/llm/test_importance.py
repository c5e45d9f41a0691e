import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from cladewise.llm import importance
from cladewise.llm.common import text_bytes
from cladewise.llm.queries import ORACLE, QUERIES
from tests.oracle import compared

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def runs(text, most):
    found = words(text)
    return [" ".join(found[i : i + n]) for n in range(1, most + 1) for i in range(len(found) - n + 1)]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def texts():
    rng = random.Random(7)
    out = [None, "", " .,", "A", "É ÀB c-d", "x" * 63, "y" * 64 + " " + "y" * 65, "z" * 500 + " q", "日本語 テキスト", "ends with a word", "begins", "{[@`0:9/]}"]
    for _ in range(300):
        out.append("".join(rng.choice(["The", "ing", " ", " ", "\n", "É", "7", "'", "-", "日", "🙂", "a" * 70]) for _ in range(rng.randrange(60))))
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_buckets_of_runs(most):
    for some in (texts(), [None], ["", ""], [], ["one"], ["a", "b"]):
        raw, offsets = text_bytes(pa.array(some, pa.string()))
        n_words, found = importance.features(raw, offsets, most)
        assert n_words.tolist() == [len(words(t)) for t in some]
        for n, (per_row, got) in enumerate(found, 1):
            want = [[bucket(" ".join(w[i : i + n])) for i in range(len(w) - n + 1)] for w in map(words, some)]
            assert per_row.tolist() == [len(x) for x in want]
            assert got.tolist() == [b for x in want for b in x]


def brute(docs, target, most=1, percent=10, least=20, buckets=10_000):
    """doc, n_words, n_features, weight, score, rank of (id, text) pairs."""
    s, t = [0] * buckets, [0] * buckets
    for held, some in ((s, [x for _, x in docs]), (t, target)):
        for x in some:
            for f in runs(x, most):
                held[bucket(f, buckets)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        own = [gain[bucket(f, buckets)] for f in runs(x, most)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(x)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    take = percent * len(order) // 100
    ranks = {}
    for k, r in enumerate(order[:take], 1):
        ranks.setdefault(r, []).append(k)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=str)


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_against_plain_loops(spark, most, percent):
    rng = random.Random(1)
    docs = [*enumerate(texts()), (None, "no id " * 30), (None, "no id"), *[(7, " ".join(["same"] * 25))] * 5]
    rng.shuffle(docs)
    target = [None, "", "the thing ing", "7 é 日"]
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in docs], "doc_id long, text string, rank int, score string").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    gains = importance.fit(df, goal, run=most)
    out = importance.draw(importance.weigh(df, gains, run=most), percent=percent)
    got = [(r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    # Repeated rows share their ranks in some order.
    assert sorted(got, key=str) == brute(docs, target, most, percent)
    if percent == 100:
        assert sorted(r[5] for r in got if r[5]) == list(range(1, sum(r[1] >= 20 for r in got) + 1))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    gains = importance.fit(empty, empty)
    assert not gains.any() and len(gains) == 10_000
    assert importance.draw(importance.weigh(empty, gains)).count() == 0


def test_query_against_plain_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in QUERIES["op12_importance_resampling"](spark, SF).collect()]
    want = [(r[0], r[2], r[3], r[4], r[5]) for r in brute(docs, target)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_and_sql_agree(spark):
    got, want, names, own = compared(spark, QUERIES["op12_importance_resampling"], ORACLE["op12_importance_resampling"], SF)
    assert names == own and got == want and len(got) == 200


def test_a_text_longer_than_a_piece():
    rng = random.Random(9)
    text = " ".join(rng.choice(["The", "ing", "É7", "x" * 90, "日本"]) + str(rng.randrange(1000)) for _ in range(600_000)) + "y" * 200_000
    assert len(text.encode()) > importance.PIECE
    some = ["before", text, None, "after it"]
    raw, offsets = text_bytes(pa.array(some))
    n_words, ((per_row, got),) = importance.features(raw, offsets)
    want = [words(t) for t in some]
    assert n_words.tolist() == per_row.tolist() == [len(w) for w in want]
    assert got.tolist() == [bucket(w) for x in want for w in x]

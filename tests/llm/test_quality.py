import random
import zlib

import numpy as np

from cladewise.llm import quality
from cladewise.llm.common import text_bytes
import pyarrow as pa


def frames(spark, n=240):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 80))]
        good = rng.random() < 0.7
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "x"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = frames(spark)
    out = quality.score(docs, quality.fit(docs, labels), "doc_id").withColumn("held_out", quality.held_out()).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 240 and len(held) > 40
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = frames(spark)
    other = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, other)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_edges(spark):
    docs, labels = frames(spark)
    ranker = quality.fit(docs, labels)
    edge = spark.createDataFrame([(1, None), (1, ""), (None, "a"), (2, " \n\t"), (3, "w " * 300_000), (4, "é"), (4, "é")], "doc_id long, text string")
    got = quality.score(edge, ranker).collect()
    assert len(got) == 7 and len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert quality.score(edge.limit(0), ranker).count() == 0
    nothing = quality.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(edge, nothing).collect()} == {0.5}
    assert {r.score for r in quality.score(edge, quality.fit(docs.limit(0), labels)).collect()} == {0.5}
    assert quality.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 1)], labels.schema))).weights.shape == ranker.weights.shape


def test_features_do_not_depend_on_neighbours():
    texts = ["One two.\nTwo", "", "x", "a a a a a a", "tab\tnew\n\nline | bar"]
    whole = quality.features(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.features(*text_bytes(pa.array([t])))[0])

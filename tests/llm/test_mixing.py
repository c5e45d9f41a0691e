import math
import random
import re

from cladewise.llm import mixing


def water(sizes, total=1.5, most=2.0, weights=(5, 2, 1)):
    """Shares again and again until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = total * sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def frame(spark, n=900):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "é", "Z", None, ""])
        text = rng.choice([None, "", " \n"]) if rng.random() < 0.05 else " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 40)))
        rows.append((i, text, source, 7))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)


def test_targets_and_whole_epochs(spark):
    rows, df = frame(spark)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    own = {}
    for i, _, s, _ in rows:
        own[s] = own.get(s, 0) + size[i]
    want = water(own)
    got = {r.id: r for r in mixing.sizes(df).collect()}
    assert len(got) == len(rows)
    for i, _, s, _ in rows:
        r = got[i]
        assert r["size"] == size[i] and r.source_size == own[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        whole = int(want[s] / own[s] + 1e-12)
        assert r.taken in (whole * size[i], (whole + 1) * size[i]) and r.taken <= 2 * size[i]
    for s in own:
        took = sum(got[i].taken for i, _, x, _ in rows if x == s)
        assert abs(took - want[s]) <= 40
    again = {r.id: r.taken for r in mixing.sizes(df.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_targets_of_many_shapes(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 20, 23):
        for spread in (1, 10, 1000):
            own = {f"s{i:02d}": rng.randrange(20, 21 + 20 * spread) for i in range(n)}
            df = spark.createDataFrame(list(own.items()), "source string, source_size long")
            want = water(own)
            for r in mixing.targets(df).collect():
                assert math.isclose(r.target, want[r.source], rel_tol=1e-9), (n, spread, r)


def test_fraction_is_the_smallest_keys(spark):
    _, df = frame(spark)
    rows, cut = mixing.plan(df)
    out = mixing.taken(rows, cut).where("size > 0").collect()
    for s in {r.source for r in out}:
        more = [r._key for r in out if r.source == s and r.copies > r.epochs]
        less = [r._key for r in out if r.source == s and r.copies == r.epochs]
        assert not more or not less or max(more) < min(less)


def test_heavier_documents_are_taken_earlier(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'w w w' as text", "cast(id % 3 as string) as source", "if(id % 2 = 0, 9.0, 1.0) as weight")
    rows, cut = mixing.plan(df, weight=mixing.F.col("weight"), weights=[1, 8, 8], total=0.6)
    out = mixing.taken(rows, cut).collect()
    first = [r for r in out if r.source == "0"]
    even = sum(r.copies for r in first if r.id % 2 == 0)
    assert even > 3 * sum(r.copies for r in first if r.id % 2)


def test_mix_rows_and_edges(spark):
    rows, df = frame(spark, 200)
    out = mixing.mix(df)
    assert out.columns == df.columns
    taken = {r.id: r for r in mixing.sizes(df).collect()}
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert all(count.get(i, 0) * r["size"] == r.taken and (r["size"] or i not in count) for i, r in taken.items())
    bare = spark.createDataFrame([(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (5, None, None)], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mix(bare).collect()} == {1}
    assert mixing.sizes(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (None, "", None), (1, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.sizes(empty).collect()] == [0, 0, 0]
    twice = spark.createDataFrame([(1, "a b", "x")] * 5, "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.sizes(twice).collect()) in (10, 20)

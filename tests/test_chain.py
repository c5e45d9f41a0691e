import itertools
import random

import pytest
from pyspark.errors import PySparkException

from cladewise.operators import blacklist as B
from cladewise.operators import relations as R

PAIRS = "tree_id long, host_1 string, host_2 string, adjacent boolean, contiguous boolean, paths12 long, paths21 long, nodes1 long, nodes2 long, ancestry string, min_dist double"


def pairs(spark, *rows, name="ancestry"):
    return spark.createDataFrame([(t, a, b, True, False, p, q, m, n, kind, x) for t, a, b, p, q, m, n, kind, x in rows], PAIRS.replace("ancestry", name))


def test_merged_windows_of_different_columns(spark):
    one = pairs(spark, (1, "b", "a", 1, 0, 3, 4, "anc", 0.2), name="path_classification")
    two = pairs(spark, (2, "a", "b", 0, 2, 1, 2, "multiDesc", 0.4)).withColumn("norm_min_dist", R.F.lit(0.1))
    constants = spark.createDataFrame([(1, 4.0), (2, 9.0)], "tree_id long, norm_const double")
    got = {r.tree_id: r for r in R.merged([one, two], constants).collect()}
    assert (got[1].host_1, got[1].host_2, got[1].ancestry, got[1].paths12, got[1].paths21, got[1].nodes1, got[1].nodes2, got[1].dist) == ("a", "b", "desc", 0, 1, 4, 3, 0.05)
    assert (got[2].ancestry, got[2].dist) == ("multiDesc", 0.1)
    assert R.merged([one]).first().dist == 0.2


@pytest.mark.parametrize("bad", [(1, "a", "a", 0, 0, 1, 1, "noAncestry", 0.1), (1, "a", "b", None, 0, 1, 1, "noAncestry", 0.1), (1, "a", "b", 0, 0, 1, 1, "noAncestry", None)])
def test_pairs_that_are_no_pairs(spark, bad):
    with pytest.raises(PySparkException):
        R.merged([pairs(spark, bad)]).collect()


def test_a_pair_that_comes_twice(spark):
    with pytest.raises(PySparkException):
        R.merged([pairs(spark, (1, "a", "b", 0, 0, 1, 1, "noAncestry", 0.1)), pairs(spark, (1, "b", "a", 0, 0, 1, 1, "noAncestry", 0.1))]).collect()


def test_hosts_with_few_reads_are_not_counted(spark):
    rows = pairs(spark, (1, "a", "b", 1, 0, 1, 1, "anc", 0.01), (2, "a", "b", 1, 0, 1, 1, "anc", 0.01))
    spans = spark.createDataFrame([(1, 1, 10), (2, 11, 20)], "tree_id long, w_start long, w_end long")
    hosts = spark.createDataFrame([(t, h, 5, 1 if (t, h) == (2, "b") else 9) for t in (1, 2) for h in "ab"], "tree_id long, host string, tips long, reads long")
    n = lambda least: {r.n for r in R.counts_of_windows([rows], spans, hosts=hosts, min_reads=least).where("k > 0").collect()}
    assert n(1) == {2} and n(5) == {1}


@pytest.mark.parametrize(("raw", "ratio"), [(12, 0.5), (2, 0.9), (0, 1.0), (100, 0.1)])
def test_duplicates_by_pairs(spark, raw, ratio):
    rng = random.Random(raw)
    tips = [(1, t, rng.choice(["A", "B", "C", None]), rng.choice([1, 5, 10, 10, 20])) for t in range(60)]
    sets = [(1, s, t) for s in range(12) for t in rng.sample(range(60), 5)]
    info, want = {t: (h, n) for _, t, h, n in tips}, set()
    for s in range(12):
        own = sorted(t for _, x, t in sets if x == s and info[t][0] is not None)
        for a, b in itertools.combinations(own, 2):
            if info[a][0] != info[b][0]:
                one, two = (b, a) if info[b][1] > info[a][1] else (a, b)
                if info[two][1] / info[one][1] < ratio or info[two][1] < raw:
                    want.add(two)
    frame = spark.createDataFrame(tips, "tree_id long, tip long, host string, reads long")
    got = B.duplicates(frame, spark.createDataFrame(sets, "tree_id long, set_id long, tip long"), raw, ratio)
    assert {r.tip for r in got.collect()} == want


def test_draws_without_replacement(spark):
    own = [1, 0, 5, 10, 34]
    tips = spark.range(3000).selectExpr("id AS tree_id", "explode(array(1L, 2L, 3L, 4L, 5L)) AS tip").selectExpr("tree_id", "tip", "'A' AS host", "element_at(array(1L, 0L, 5L, 10L, 34L), cast(tip AS int)) AS reads")
    rows = B.downsampled(tips, 12).collect()
    by_tip = {t: [r.drawn for r in rows if r.tip == t] for t in range(1, 6)}
    total = {}
    for r in rows:
        total[r.tree_id] = total.get(r.tree_id, 0) + r.drawn
    assert set(total.values()) == {12} and len(total) == 3000
    for t, n in enumerate(own, 1):
        mean, spread = 12 * n / 50, 12 * (n / 50) * (1 - n / 50) * (50 - 12) / 49
        got = sum(by_tip[t]) / 3000
        assert max(by_tip[t]) <= n and abs(got - mean) < 5 * (spread / 3000) ** 0.5 + 1e-9
        assert abs(sum((x - mean) ** 2 for x in by_tip[t]) / 3000 - spread) < 0.15 * spread + 1e-9
    # Chi-square of the commonest tip's draws against the hypergeometric law.
    from math import comb

    law = {k: 3000 * comb(34, k) * comb(16, 12 - k) / comb(50, 12) for k in range(13)}
    chi = sum((sum(x == k for x in by_tip[5]) - e) ** 2 / e for k, e in law.items() if e > 5)
    assert chi < 30
    assert sorted(map(tuple, rows)) == sorted(map(tuple, B.downsampled(tips.repartition(7), 12).collect()))


def test_hosts_short_of_reads(spark):
    tips = spark.createDataFrame([(1, 1, "A", 2), (1, 2, "A", 3), (1, 3, None, 9), (1, 4, "B", 10**6)], "tree_id long, tip long, host string, reads long")
    assert {(r.tip, r.drawn) for r in B.downsampled(tips, 6).collect()} == {(1, 2), (2, 3), (4, 6)}
    assert {(r.tip, r.drawn) for r in B.downsampled(tips, 6, keep_short=False).collect()} == {(1, 0), (2, 0), (4, 6)}


def test_each_step_sees_what_is_left(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, 0.0, False, None, 0), (1, 2, 1, 1.0, True, "A", 9), (1, 3, 1, 1.0, False, None, 0), (1, 4, 3, 1.0, True, "A", 1), (1, 5, 3, 1.0, True, "B", 1)],
        "tree_id long, node long, parent long, edge_length double, is_tip boolean, host string, reads long",
    )
    listed = spark.createDataFrame([(1, 2)], "tree_id long, tip long")
    sets = spark.createDataFrame([(1, 1, 2), (1, 1, 5)], "tree_id long, set_id long, tip long")
    status = lambda **x: {r.tip: r.status for r in B.cleaned_in_order(nodes, **x).collect()}
    assert status() == {2: "included", 4: "included", 5: "included"}
    assert status(sets=sets, raw=2) == {2: "included", 4: "included", 5: "bl_duplicate"}
    # Without tip 2 nothing is a duplicate of tip 5, and A has one tip.
    assert status(listed=listed, sets=sets, raw=2) == {2: "bl_user_specified", 4: "included", 5: "included"}
    assert status(listed=listed, min_tips=2) == {2: "bl_user_specified", 4: "bl_too_few_tips", 5: "bl_too_few_tips"}
    # The root is unassigned, so A has two subgraphs, one of which is rare.
    assert status(k=1.0, raw=2, ratio=0.0) == {2: "included", 4: "bl_parsimony_contaminant", 5: "bl_parsimony_contaminant"}
    with pytest.raises(ValueError):
        status(dual_threshold=0.5)


def test_alignments_have_the_names_of_their_trees(spark):
    tips = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "tree_id long, tip long")
    rows = [(1, 1, "AC"), (1, 2, "A-"), (2, 1, "GG")]
    frame = lambda some: spark.createDataFrame(some, "tree_id long, tip long, seq string")
    assert sorted(map(tuple, B.attached(tips, frame(rows)).collect())) == rows
    status = tips.withColumn("kept", R.F.col("tip") == 1)
    assert sorted(map(tuple, B.cleaned(frame(rows), status).collect())) == [rows[0], rows[2]]
    for bad, said in ((rows[:2], "no sequence"), ([*rows, (2, 9, "G")], "no tip"), ([*rows, rows[0]], "more than one")):
        with pytest.raises(PySparkException, match=said):
            B.cleaned(frame(bad), status).collect()


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_in_one_task_and_by_rounds(spark, most):
    from cladewise.operators import networks as N

    rng = random.Random(3)
    edges = [(f"h{rng.randrange(60):02d}", f"h{rng.randrange(60):02d}") for _ in range(40)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(70)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in N.components(spark.createDataFrame(edges, "host_1 string, host_2 string"), most=most).collect()}
    assert got == label
    assert N.components(spark.createDataFrame([], "host_1 string, host_2 string"), most=most).count() == 0


def some_trees(n):
    """Rows tree_id, node, parent, edge_length, host, reads of random trees; some have a tip as root, two roots or a host called unassigned."""
    rng, out = random.Random(5), []
    for g in range(n):
        size = rng.choice([1, 2, 3, 10, 40])
        ids = rng.sample(range(1, 200), size)
        rows = [(g, ids[j], ids[max(0, j - rng.randint(1, 4))] if j else None, rng.choice([0.0, 0.1, 0.25, 0.3, None]), rng.choice([None, "A", "B", "C"]), rng.choice([None, 1, 2, 7])) for j in range(size)]
        rows += [(g, 500, None, 0.0, "A", 3)] if g % 7 == 3 else []
        out.append(sorted(((*r[:4], "unassigned" if g % 11 == 5 and r[4] == "B" else r[4], r[5]) for r in rows), key=lambda r: r[1]))
    return out


@pytest.mark.parametrize("numbers", [10**6, 20])
@pytest.mark.parametrize("k", [0.0, 1.0, 20.0])
def test_subgraphs_of_many_trees_at_once(monkeypatch, k, numbers):
    from cladewise.operators import kernels as K

    monkeypatch.setattr(K, "NUMBERS", numbers)
    trees = some_trees(150)
    want = [(t[0][0], *x) for t in trees for x in K._plain_host_subgraphs(*([r[c] for r in t] for c in range(1, 6)), k)]
    rows = [r for t in trees for r in t]
    got = list(zip(*K.host_subgraphs(*([r[c] for r in rows] for c in range(6)), k)))
    assert sorted(got) == sorted(want) and any("-SPLIT2" in x[2] for x in want)


def test_trees_go_on_in_the_next_batch_and_not_one_by_one(spark, monkeypatch):
    from cladewise.operators import kernels as K

    trees = [t for t in some_trees(60) if len(t) > 1 and t[0][0] % 7 != 3 and t[0][0] % 11 != 5]
    want = sorted((t[0][0], *x) for t in trees for x in K._plain_host_subgraphs(*([r[c] for r in t] for c in range(1, 6)), 2.0))
    nodes = spark.createDataFrame([r for t in trees for r in t], "tree_id long, node long, parent long, edge_length double, host string, reads long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, B.host_splits(nodes, 2.0).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(K, "parsimony", None)
    rows = [r for t in trees for r in t]
    assert sorted(zip(*K.host_subgraphs(*([r[c] for r in rows] for c in range(6)), 2.0))) == want

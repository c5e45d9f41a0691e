import itertools

import pytest

from cladewise.operators import reports as P


def test_batches_of_two(spark):
    names = [f"n{i:02d}" for i in range(11)]
    got = sorted(tuple(r) for r in P.batched(spark.createDataFrame([(n,) for n in [*names, "n03"]], "ind string").repartition(3), 3).collect())
    parts = [names[i : i + 3] for i in range(0, 11, 3)]
    want = [(run, n, a + 1, b + 1) for run, (a, b) in enumerate(itertools.combinations(range(4), 2), 1) for n in parts[a] + parts[b]]
    assert got == sorted(want)
    assert P.batched(spark.createDataFrame([], "ind string")).count() == 0
    assert P.batched(spark.createDataFrame([("a",)], "ind string")).count() == 0


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 1000).selectExpr("id * 7919 % 1000 as x").repartition(7)
    assert [(r.x, r.number) for r in P.numbered(df, "x").orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]


def test_grid_has_absent_pairs(spark):
    pairs = spark.createDataFrame([("t1", "a", "b", "anc", True, False, 0.01), ("t2", "a", "c", "complex", True, True, 0.9)], "tree_id string, host_1 string, host_2 string, ancestry string, adjacent boolean, contiguous boolean, dist double")
    there = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "a"), ("t2", "c"), ("t2", "b")], "tree_id string, host string")
    got = {(r.tree_id, r.host_1, r.host_2): r for r in P.pair_grid(pairs, ["c", "a", "b"], there, 0.05).collect()}
    assert len(got) == 6
    r = got["t2", "a", "b"]
    assert r.not_present and r.host_1_present and r.host_2_present and r.any_link and r.linked is None and r.nondir_ancestry is None
    assert got["t1", "a", "b"].linked and got["t1", "a", "b"].nondir_ancestry == "trans"
    assert not got["t2", "a", "c"].within_distance and not got["t2", "a", "c"].any_link and not got["t1", "a", "c"].host_2_present


@pytest.mark.parametrize(("one", "two", "want"), [(["a", "b"], ["b", "a", "a"], (True, 0, 0)), (["a"], ["b", "c"], (False, 1, 2)), ([], [], (True, 0, 0))])
def test_same_names(spark, one, two, want):
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    assert tuple(P.same_names(frame(one), frame(two)).first()) == want


def test_lines_without_a_metric_come_last(spark):
    found = spark.createDataFrame([(1, "x", 0.1), (1, "y", 0.5)], "window_id long, sample string, metric double")
    samples = spark.createDataFrame([(1, s) for s in "zyxw"], "window_id long, sample string")
    assert [(r.line, r.sample, r.metric) for r in P.recombination_report(found, samples).orderBy("line").collect()] == [(1, "y", 0.5), (2, "x", 0.1), (3, "w", None), (4, "z", None)]

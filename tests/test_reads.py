import itertools

import pytest
from pyspark.sql import functions as F

from cladewise.functions import reads as FR
from cladewise.operators import reads as R
from cladewise.operators import windows as W
from cladewise.plans import read_queries as Q
from cladewise.plans.views import view


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_ends_are_recovered(spark):
    p = [None, None, 10, 11, 13, 14, None, None, None]
    assert one(spark, "p array<int>", (p,), FR.recovered_ends(F.col("p")))[0] == [8, 9, 10, 11, 13, 14, 15, 16, 17]
    assert one(spark, "p array<int>", ([None, None],), FR.recovered_ends(F.col("p")))[0] == [None, None]


def test_spans_trims_and_qualities(spark):
    spans = lambda p, a, b: one(spark, "p array<int>", (p,), FR.spans_window(F.col("p"), F.lit(a), F.lit(b)))[0]
    assert spans([None, 3, 4, 9], 3, 9) and not spans([3, 4], 2, 4) and not spans([None], 1, 1)
    both = lambda r: (r["a"], r["n"])
    assert one(spark, "q array<int>", ([1, 9, 2, 9, 1],), *both(FR.trim_range(F.col("q"), 5))) == (2, 3)
    assert one(spark, "q array<int>", ([1, 1],), *both(FR.trim_range(F.col("q"), 5)))[1] == 0
    low = lambda q: one(spark, "q array<int>", (q,), FR.low_quality(F.col("q"), 5))[0]
    assert not low([9, 4, 9]) and low([4, 4, 9])


def test_processing_in_order(spark):
    df = spark.createDataFrame([("ACGTAC", [None, 2, 3, 4, 5, None], [9, 9, 9, 9, 9, 1])], "seq string, positions array<int>, quals array<int>")
    got = R.processed(df, F.lit(2), F.lit(4), trim=5, low=5, recover=True).first()
    assert (got.seq, got.positions) == ("CGT", [2, 3, 4])
    assert R.processed(df, F.lit(1), F.lit(6), trim=5, recover=True).count() == 0
    assert R.processed(df, F.lit(2), F.lit(4), recover=True, keep_overhangs=True).first().seq == "ACGTAC"


def test_mates(spark):
    schema = "sample string, name string, seq string, positions array<int>, quals array<int>"
    rows = [
        ("s", "a", "ACGT", [1, 2, 3, 4], [9, 9, 1, 9]), ("s", "a", "TTCC", [3, 4, 5, 6], [5, 9, 9, 9]),
        ("s", "b", "AC", [1, 2], [9, 9]), ("s", "b", "GT", [5, 6], [9, 9]),
        ("s", "c", "ACG", [1, 2, 4], [9, 9, 9]), ("s", "c", "CGT", [2, 3, 4], [9, 9, 9]),
        ("s", "d", "AA", [7, 8], [9, 9]),
    ]
    got = {r.name: (r.seq, r.positions, r.quals) for r in R.merged_mates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("ACTTCC", [1, 2, 3, 4, 5, 6], [9, 9, 5, 9, 9, 9]), "d": ("AA", [7, 8], [9, 9])}


def test_a_third_read_of_a_name_is_an_error(spark):
    rows = [("s", "a", "AC", [k, k + 1], [9, 9]) for k in range(3)]
    with pytest.raises(Exception, match="more than two reads of the name a"):
        R.merged_mates(spark.createDataFrame(rows, "sample string, name string, seq string, positions array<int>, quals array<int>")).collect()


def test_templates_take_all_reads(spark):
    sf = "/root/testdata/sf0.001"
    reads = Q.templates(view(spark, sf, "v_reads"))
    assert reads.groupBy("sample", "name").count().agg(F.max("count")).first()[0] == 2
    of_reads = F.sum(F.when(F.col("kind") == "overlapping", 2 * F.col("n")).otherwise(F.col("n")))
    assert Q.QUERIES["template_insert_sizes"](spark, sf).agg(of_reads).first()[0] == reads.count()
    single = reads.groupBy("sample", "name").count().where("count = 1").count()
    merged = Q.QUERIES["merged_mates"](spark, sf)
    assert merged.select("sample", "name").distinct().count() == merged.count() > single


def test_columns_of_gaps_go_and_no_sequence_does(spark):
    rows = [(w, i, pos, b) for w, i, seq in ((0, 1, "A--C-"), (0, 2, "--GC-"), (1, 3, "-A---")) for pos, b in enumerate(seq, 1)]
    df = spark.createDataFrame(rows, "window_id long, seq_id long, pos int, base string")
    got = {r.seq_id: r.seq for r in R.reassembled(R.without_gap_columns(df), "seq_id").collect()}
    assert got == {1: "A-C", 2: "-GC", 3: "A"}
    sf = "/root/testdata/sf0.001"
    assert Q.QUERIES["all_columns_with_bases"](spark, sf).select("seq_id").distinct().count() == view(spark, sf, "customer").count()


def near(counts, threshold):
    """Sequences within the threshold of each."""
    apart = lambda a, b: abs(len(a) - len(b)) + sum(x != y for x, y in zip(a, b))
    return {a: [b for b, _ in counts if a != b and apart(a, b) <= threshold] for a, _ in counts}


def test_merges_keep_counts_and_their_order():
    counts = [("AAAA", 10), ("AAAT", 4), ("AATT", 2), ("CCCC", 2), ("CCCA", 2)]
    assert R.absorb_common_first(counts, near(counts, 1)) == {"AAAA": 14, "AATT": 2, "CCCC": 2, "CCCA": 2}
    assert R.absorb_rare_first(counts, near(counts, 1), 1) == {"AAAA": 16, "CCCA": 4}
    some = [("AAAA", 3), ("AAAAAA", 2), ("AAAC", 1)]
    assert R.absorb_rare_first(some, near(some, 1), 1) == {"AAAA": 4, "AAAAAA": 2}


@pytest.mark.parametrize("seqs, metric", [(["AAAAAAA", "AAAACCC", "CCCCCCC"], 1.0), (["A-AAAA", "A-AAA-", "AAAA-A"], 0.0), (["AA", "AC"], 0.0)])
def test_recombination(seqs, metric):
    for order in itertools.permutations(seqs):
        assert R.recombination_metric(list(order))[0] == metric


def test_explicit_windows_are_checked(spark):
    for bad in ([1], [0, 5], [5, 5], []):
        with pytest.raises(ValueError):
            W.explicit_windows(spark, bad)
    for bad in ([1], [0, 5], [5, 5]):
        with pytest.raises(Exception, match="window bounds"):
            W.explicit_over(spark.createDataFrame([(1, bad)], "k int, bounds array<long>"), "k").collect()
    spans = spark.createDataFrame([("a", 5, 40), ("b", 1, 9), ("c", 1, 10)], "ref string, first long, last long")
    assert [tuple(r) for r in W.sliding_over(spans, 10, 0, "ref").orderBy("ref", "w_start").collect()] == [("a", 0, 5, 14), ("a", 1, 15, 24), ("a", 2, 25, 34), ("c", 0, 1, 10)]
    assert [tuple(r) for r in W.increment_over(spans, 10, 13, "ref").orderBy("ref", "w_start").collect()] == [("a", 5, 14), ("a", 18, 27), ("a", 31, 40), ("c", 1, 10)]
    assert W.exploratory_over(spans, [10, 36, 99], "ref").where("ref = 'a'").count() == 4
    assert [r.w_start for r in W.sliding_windows(spark, 300, -700, 1000, 8300).collect()] == list(range(1000, 8001, 1000))


def test_coordinates(spark):
    df = spark.createDataFrame([("x", i + 1, b) for i, b in enumerate("-a--cg-t-")], "seq_id string, pos int, base string")
    at = spark.createDataFrame([("x", k) for k in (1, 2, 3)], "seq_id string, seq_pos long")
    assert [r.pos for r in W.sequence_to_alignment(df, at).orderBy("pos").collect()] == [2, 5, 6]
    places = [str(r.seq_pos) for r in W.aligned_places(df).orderBy("pos").collect()]
    assert places == ["-1.0", "1.0", "1.5", "1.5", "2.0", "3.0", "3.5", "4.0", "nan"]


def test_recombination_by_a_plain_loop():
    """The definition, breakpoint by breakpoint, on strings with gaps: sides of one sum are no breakpoint."""
    import itertools
    import random

    def plain(seqs):
        columns = sum(any(s[c] != "-" for s in seqs) for c in range(len(seqs[0])))
        best = 0
        for one, two in itertools.combinations(range(len(seqs)), 2):
            sites = [c for c in range(len(seqs[0])) if "-" not in (seqs[one][c], seqs[two][c]) and seqs[one][c] != seqs[two][c]]
            for third in set(range(len(seqs))) - {one, two}:
                sides = [(seqs[third][c] == seqs[one][c]) - (seqs[third][c] == seqs[two][c]) for c in sites]
                largest, score = 0, 0
                for k in range(1, len(sides)):
                    left, right = sum(sides[:k]), sum(sides[k:])
                    if abs(left - right) > largest:
                        largest, score = abs(left - right), min(abs(left), abs(right))
                best = max(best, score)
        return best / max(1, columns // 2)

    assert R.recombination_metric(["AAA", "CCA", "AA-"])[0] == 0
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randrange(2, 9)
        seqs = ["".join(rng.choice("AC-") for _ in range(n)) for _ in range(rng.randrange(3, 6))]
        assert R.recombination_metric(seqs)[0] == plain(seqs), seqs


def test_merging_by_plain_loops():
    """Both orders, pair by pair."""
    import random

    far = lambda a, b: abs(len(a) - len(b)) + sum(x != y for x, y in zip(a, b))

    def common_first(counts, threshold):
        rows, total, gone = sorted(counts, key=lambda r: (r[1], r[0])), dict(counts), set()
        for i in reversed(range(len(rows))):
            for other, m in rows[:i]:
                if rows[i][0] in gone or other in gone or m == rows[i][1]:
                    continue
                if far(rows[i][0], other) <= threshold:
                    total[rows[i][0]] += total.pop(other)
                    gone.add(other)
        return total

    def rare_first(counts, threshold):
        rows, total = [s for s, _ in sorted(counts, key=lambda r: (-r[1], r[0]))], dict(counts)
        for i in reversed(range(1, len(rows))):
            for other in rows[:i]:
                if abs(len(rows[i]) - len(other)) > threshold:
                    break
                if far(rows[i], other) <= threshold:
                    total[other] += total.pop(rows[i])
                    break
        return total

    rng = random.Random(7)
    for _ in range(300):
        seqs = {"".join(rng.choice("AC") for _ in range(rng.choice([4, 5, 6]))) for _ in range(rng.randrange(1, 12))}
        counts = [(s, rng.randrange(1, 6)) for s in sorted(seqs)]
        for threshold in (0, 1, 2):
            assert R.absorb_common_first(counts, near(counts, threshold)) == common_first(counts, threshold)
            assert R.absorb_rare_first(counts, near(counts, threshold), threshold) == rare_first(counts, threshold)
    assert R.absorb_common_first([], {}) == {} and R.absorb_rare_first([], {}, 1) == {}


@pytest.mark.parametrize("threshold", [0, 1, 3])
def test_similar_sequences_over_many_groups(spark, threshold):
    import random

    rng = random.Random(threshold)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(8)]
    groups = {}
    for g in range(6):
        seqs = set()
        for _ in range(60 if g else 1):
            s = list(rng.choice(base))
            for _ in range(rng.randrange(5)):
                s[rng.randrange(60)] = rng.choice("ACGT-")
            seqs.add("".join(s)[: 60 - rng.choice([0, 0, 0, 1, 2])])
        groups[g // 2, f"s{g % 2}"] = [(s, rng.randrange(1, 5)) for s in sorted(seqs)]
    df = spark.createDataFrame([(w, h, s, n) for (w, h), own in groups.items() for s, n in own], "window_id int, sample string, seq string, n long")
    for version, plain in (("A", lambda c: R.absorb_common_first(c, near(c, threshold))), ("B", lambda c: R.absorb_rare_first(c, near(c, threshold), threshold))):
        got = {}
        for r in R.similar_merged(df, threshold, version).collect():
            got.setdefault((r.window_id, r.sample), {})[r.seq] = r.n
        assert got == {k: plain(c) for k, c in groups.items()}
    pairs = [tuple(sorted((r.a, r.b))) + (r.window_id, r["sample"]) for r in R.similar_pairs(df, threshold).collect()]
    want = {(*sorted((a, b)), *k) for k, c in groups.items() for a, others in near(c, threshold).items() for b in others}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    # Pairs of different origin share no piece: far fewer are compared than there are.
    together = R.pieces(df, threshold).groupBy("window_id", "sample", "part", "piece").count().selectExpr("sum(count * (count - 1) / 2) AS n").first().n
    assert together < (threshold + 1) * 0.3 * sum(len(c) * (len(c) - 1) / 2 for c in groups.values())


def test_insert_sizes_take_all_reads(spark):
    sf = "/root/testdata/sf0.001"
    of_reads = F.sum(F.when(F.col("kind") == "overlapping", 2 * F.col("n")).otherwise(F.col("n")))
    assert Q.QUERIES["insert_sizes"](spark, sf).agg(of_reads).first()[0] == view(spark, sf, "v_reads").count()


@pytest.mark.parametrize("tile", [1, 3, 64])
def test_recombination_by_tiles(spark, tile):
    import random

    rng = random.Random(tile)
    groups = {g: [s for s in ("".join(rng.choice("ACG-") for _ in range(12)) for _ in range(8)) for _ in range(rng.choice([1, 1, 3]))] for g in range(6)} | {9: ["ACGT", "ACGA"]}
    df = spark.createDataFrame([(g, s) for g, own in groups.items() for s in own], "window_id long, seq string")
    for gap_aware in (False, True):
        got = {r.window_id: (r.metric, (r.parent_1, r.parent_2, r.recombinant)) for r in R.recombination(df, "window_id", gap_aware=gap_aware, tile=tile).collect()}
        want = {g: R.recombination_metric(sorted(own), gap_aware) for g, own in groups.items()}
        assert got == {g: (m, found or (None, None, None)) for g, (m, found) in want.items()}


def test_contaminants_by_pairs(spark):
    import random

    rng = random.Random(4)
    rows = [(w, h, s, rng.randrange(1, 12)) for w in range(3) for h in "abcdefg" for s in ("AA", "CC", "GG") if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "window_id int, sample string, seq string, n long")
    for ratio in (2.0, 3.0, 1.0):
        want = {(w, h, s) for w, h, s, n in rows if any(x == w and t == s and g != h and m / n >= ratio for x, g, t, m in rows)}
        assert {tuple(r) for r in R.contaminants(df, ratio).collect()} == want


def test_reads_meet_their_orders_once(spark, monkeypatch):
    from cladewise.operators import windows as W
    from cladewise.plans import read_queries, views

    sf = "/root/testdata/sf0.001"
    needs = {n: views.view(spark, sf, n) for n in ("lineitem", "orders", "customer")}
    plain, own = spark.sql(views._spelled(views.VIEWS["v_reads"], "spark"), **needs), views.view(spark, sf, "v_reads")
    assert own.dtypes == plain.dtypes and own.exceptAll(plain).isEmpty() and plain.exceptAll(own).isEmpty()
    few = sorted(map(tuple, read_queries.tips(spark, sf).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = read_queries.tips(spark, sf)._jdf.queryExecution().executedPlan().toString()
        # Rows of lineitem are shuffled by order only: not by customer afterwards, nor by bin.
        assert plan.index("SortMergeJoin [l_orderkey") < plan.index("SortMergeJoin [o_custkey") and "hashpartitioning(_bin" not in plan
        monkeypatch.setattr(W, "FEW", 0)
        many = read_queries.tips(spark, sf)
        assert "hashpartitioning(_bin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect())) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

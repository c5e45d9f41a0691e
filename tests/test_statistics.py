import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cladewise.operators import reads as R
from cladewise.operators import statistics as S
from cladewise.operators import trees as T
from tests.test_trees import tree

SCHEMA = "tree_id long, node long, parent long, edge_length double, is_tip boolean, host string, reads long, subgraph string"


@pytest.fixture(scope="module")
def forest(spark):
    trees = {seed: tree(seed, "ABC", 9) for seed in range(12)}
    rows = [(s, t.id[i], None if t.parent[i] < 0 else t.id[t.parent[i]], float(t.length[i]), bool(t.tip[i]), t.host[i], 1 + i % 3, f"{t.host[i]}-{i % 2}" if t.host[i] else None) for s, t in trees.items() for i in range(len(t.id))]
    nodes = spark.createDataFrame(rows, SCHEMA).cache()
    return {s: {r[1]: r for r in rows if r[0] == s} for s in trees}, nodes, T.closure(nodes).cache(), nodes.where("is_tip and host is not null")


def ups(rows, n):
    out = []
    while n is not None:
        out.append(n)
        n = rows[n][2]
    return out


def path(rows, a, b):
    x, y = ups(rows, a), ups(rows, b)
    top = next(n for n in x if n in y)
    return x[: x.index(top) + 1] + y[: y.index(top)][::-1], top


def far(rows, a, b):
    nodes, top = path(rows, a, b)
    return sum(rows[n][3] for n in nodes if n != top)


def top_of(rows, tips):
    return next(n for n in ups(rows, tips[0]) if all(n in ups(rows, t) for t in tips))


def tips_of(rows):
    out = defaultdict(list)
    for n, r in rows.items():
        if r[4] and r[5]:
            out[r[5]].append(n)
    return out


def mean_rtt(rows, tips):
    top = top_of(rows, tips)
    return sum(far(rows, t, top) * rows[t][6] for t in tips) / sum(rows[t][6] for t in tips)


def branches(rows, tips):
    """Pruned by hand: branches that only lead to one child with tips are joined; so are a root's two."""
    top = top_of(rows, tips)
    on = {n for t in tips for n in ups(rows, t) if top in ups(rows, n)}
    kids = {n: [c for c in on if rows[c][2] == n] for n in on}
    out, at_root = [], []
    for n in on - {top}:
        if len(kids[n]) == 1:
            continue
        d, m = 0.0, n
        while m != top and (m == n or len(kids[m]) == 1):
            d, m = d + rows[m][3], rows[m][2]
        (at_root if m == top else out).append(d)
    return out + ([sum(at_root)] if len(at_root) == 2 else at_root)


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


def test_subtree_and_window_statistics(spark, forest):
    by_tree, nodes, up, tips = forest
    hosts = spark.createDataFrame([(h,) for h in "ABCZ"], "host string")
    constants = spark.createDataFrame([(s, 2.0) for s in range(6)], "tree_id long, norm_const double")
    duals = spark.createDataFrame([(0, "A", 2)], "tree_id long, host string, dual_count long")
    got = {(r.tree_id, r.host): r for r in S.window_statistics(up, nodes, tips, hosts, constants, duals=duals).collect()}
    assert len(got) == 4 * len(by_tree)
    for s, rows in by_tree.items():
        of = tips_of(rows)
        for h in "ABCZ":
            own, r = of[h], got[s, h]
            parts = defaultdict(list)
            for t in own:
                parts[rows[t][7]].append(t)
            assert (r.tips, r.reads, r.subgraphs) == (len(own), sum(rows[t][6] for t in own), len(parts))
            assert (r.clades > 0) == bool(own) and r.dual_count == (2 if (s, h) == (0, "A") else None)
            want = [None] * 6
            if own:
                best = parts[min(parts, key=lambda p: (-sum(rows[t][6] for t in parts[p]), p))]
                mean = lambda x: sum(far(rows, *p) for p in itertools.combinations(x, 2)) / (len(x) * (len(x) - 1) / 2) if len(x) > 1 else None
                want = [mean_rtt(rows, own), mean_rtt(rows, best), max(branches(rows, own)) if len(own) > 1 else None, max((far(rows, *p) for p in itertools.combinations(own, 2)), default=None), mean(own), mean(best)]
            for c, w in zip(S.STATISTICS, want, strict=True):
                assert near(r[c], w), (s, h, c, r[c], w)
                assert near(r[f"normalised_{c}"], w if w is None or s > 5 else w / 2)


def test_descent_and_intermingling(forest):
    by_tree, _, up, tips = forest
    got = {(r.tree_id, r.host_1, r.host_2): tuple(r)[3:] for r in S.host_descent(up, tips).collect()}
    n = 0
    for s, rows in by_tree.items():
        of = tips_of(rows)
        top = {h: top_of(rows, of[h]) for h in of}
        over = lambda a, b: top[a] in ups(rows, top[b])[1:]
        reach = lambda a, b: any(top[b] in ups(rows, t)[1:] for t in of[a])
        for a, b in itertools.combinations(sorted(of), 2):
            n += 1
            assert got[s, a, b] == (over(a, b) and not reach(a, b), over(b, a) and not reach(b, a), top[a] == top[b] or over(a, b) and reach(a, b) or over(b, a) and reach(b, a))
    assert n == len(got) > 0


def test_paths_and_reachable_tips(spark, forest):
    by_tree, nodes, up, _ = forest
    asked = [(s, a, b, c) for s in (0, 1) for a, b, c in itertools.product(by_tree[s], repeat=3)]
    got = S.path_exists(up, spark.createDataFrame(asked, "tree_id long, node_1 long, node_2 long, node_3 long")).collect()
    assert len(got) == len(asked)
    for s, a, b, c, is_open in got:
        assert is_open == (a == b or c == b or c not in path(by_tree[s], a, b)[0]), (s, a, b, c)
    blocked = [(s, n) for s, rows in by_tree.items() for n in rows if n % 3 == 1]
    starts = [(s, n) for s, rows in by_tree.items() for n in rows]
    reached = S.reachable_tips(up, nodes, spark.createDataFrame(blocked, "tree_id long, node long"), spark.createDataFrame(starts, "tree_id long, start long"))
    reached = {(r.tree_id, r.start, r.tip) for r in reached.collect()}
    want = set()
    for s, n in starts:
        for t, r in by_tree[s].items():
            nodes_on, top = path(by_tree[s], n, t)
            if r[4] and not any((s, x) in set(blocked) for x in nodes_on if x != top):
                want.add((s, n, t))
    assert reached == want


def test_sequences_are_found(spark):
    df = spark.createDataFrame([("ab1", "A-CG"), ("ab2", "--?-"), ("c", "ACGT")], "name string, seq string")
    names = lambda *a, **k: sorted((r.name, r.seq) for r in R.found_sequences(df, *a, **k).collect())
    assert names(["c"]) == [("c", "ACGT")] and names(["c"], inverted=True) == [("ab1", "A-CG"), ("ab2", "--?-")]
    assert names(["ab"], prefix=True, window=(2, 4), gap_strip=True, skip_blanks=True) == [("ab1", "CG")]
    for bad in (lambda: names(["ab1", "x"]), lambda: names(["x"], prefix=True), lambda: names(["c"], window=(1, 5)), lambda: R.found_sequences(df.union(df), ["c"])):
        with pytest.raises(ValueError):
            bad()

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.operators import flows as W
from cladewise.operators import kernels as K
from cladewise.operators import trees as T


def tree(seed, hosts="AB", n=7):
    rng = random.Random(seed)
    node, parent, length, host = [0], [None], [0.0], [None]
    tips = [0]
    while len(tips) < n:
        t = tips.pop(rng.randrange(len(tips)))
        for _ in range(rng.choice([2, 2, 3])):
            node.append(len(node)), parent.append(t), length.append(rng.choice([0.0, 0.1, 0.5])), host.append(None)
            tips.append(node[-1])
    for t in tips:
        host[t] = rng.choice([*hosts, None])
    return K.Tree(node, parent, length, host, [rng.choice([1, 3]) for _ in node])


def cost_of(t, state, k):
    own, total = t.subtree_costs(), 0.0
    for c, p in enumerate(t.parent):
        if p >= 0 and state[c] != state[p] and state[c] != K.UNASSIGNED:
            total += (t.weight[c] if t.tip[c] else 1) + (k * own[c, t.hosts.index(state[c])] if k else 0)
    return total


def test_parsimony_against_all_assignments():
    for seed in range(25):
        t = tree(seed)
        inner = [i for i in range(len(t.id)) if not t.tip[i] and i not in t.roots]
        for k in (0.0, 2.0):
            best = np.inf
            for choice in itertools.product(t.hosts, repeat=len(inner)):
                state = [t.host[i] or K.UNASSIGNED for i in range(len(t.id))]
                state[t.roots[0]] = K.UNASSIGNED
                for i, s in zip(inner, choice):
                    state[i] = s
                best = min(best, cost_of(t, state, k))
            cost = K.parsimony(t, k)
            assert np.isclose(cost[t.roots[0]].rest, best)
            state = K.trace(t, cost, k, 0.2)
            assert np.isclose(cost_of(t, state, k), best) and all(state[i] == (t.host[i] or K.UNASSIGNED) for i in range(len(t.id)) if t.tip[i])


def all_states(t, k, p):
    """Costs of all states of all nodes in one array, and the states that follow: no host is left out anywhere."""
    n, own = len(t.hosts), t.subtree_costs()
    cost = np.full((len(t.id), n), np.inf)

    def change(c):
        paid = cost[c] + (t.weight[c] if t.tip[c] else 1.0) + (k * own[c] if k else 0.0)
        out = np.tile(np.where(np.isnan(paid), np.inf, paid), (n, 1))
        out[:, -1] = cost[c, -1]
        out[np.arange(n), np.arange(n)] = cost[c]
        return out

    for i in t.up:
        if t.tip[i]:
            cost[i, t.hosts.index(t.host[i]) if t.host[i] else -1] = 0
        else:
            cost[i] = sum(change(c).min(axis=1) for c in t.children[i])
    state = [n - 1] * len(t.id)
    for i in t.down:
        for c in t.children[i]:
            row = change(c)[state[i]]
            best = np.flatnonzero(row == row.min())
            tie = len(best) > 1 and n - 1 in best and state[i] in best
            state[c] = (n - 1 if t.length[c] > p else state[i]) if tie else int(best[0])
    return float(cost[t.roots[0], -1]), [t.hosts[s] for s in state]


def test_states_without_those_of_absent_hosts():
    for seed in range(120):
        t = tree(seed, "ABCDEF"[: 2 + seed % 5], 18)
        t.length = [x * 4 // 1 / 8 for x in t.length]  # sums without rounding, so that ties are ties
        for k, p in ((0.0, 0.0), (2.0, 0.2), (1.0, 5.0)):
            cost = K.parsimony(t, k)
            want, states = all_states(t, k, p)
            assert cost[t.roots[0]].rest == want and K.trace(t, cost, k, p) == states
            assert all(len(x.hosts) <= len(set(t.hosts)) for x in cost)


def test_continuation_against_all_changes():
    for seed in range(40):
        t = tree(seed, "ABCD", 14)
        k, p, n = 0.05, 0.3, len(t.hosts)
        cost, states = K.continuation(t, k, p)
        want = K._states_of_tips(t)

        def change(c):
            out = np.tile(want[c] + (1 / k - p) * (t.weight[c] if t.tip[c] else 1.0), (n, 1))
            for h in range(n - 1):
                out[h, h] = want[c, h] + t.length[c]
            out[:, -1] = want[c, -1] + p
            return out

        for i in t.up:
            if not t.tip[i]:
                want[i] = sum(change(c).min(axis=1) for c in t.children[i])
        assert np.allclose(cost, want)
        for i in t.down:
            for c in t.children[i]:
                assert np.isclose(change(c)[t.hosts.index(states[i]), t.hosts.index(states[c])], change(c)[t.hosts.index(states[i])].min())


def test_splits_and_collapse():
    t = K.Tree([0, 1, 2, 3, 4, 5, 6], [None, 0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 1, 1, 1], [None, None, None, "A", "A", "A", "B"])
    state = ["unassigned", "A", "unassigned", "A", "A", "A", "B"]
    name, first = K.splits(t, state)
    assert len({n for n, s in zip(name, state) if s == "A"}) == 2 and name[6] == "B"
    rows = K.collapsed(t, name, first, state)
    (pair,) = K.classified(rows, t, name)
    assert pair[:4] == ("A", "B", True, True) and pair[8] == "noAncestry"


def loops(rows, t, name):
    """Pairs of hosts by plain loops over pairs of subgraphs."""
    up, host, root = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}, {r[0]: t.id.index(r[5]) for r in rows}

    def chain(s):
        return [s, *(chain(up[s]) if up[s] is not None else [])]

    def path(a, b):
        x, y = chain(a), chain(b)
        met = next(s for s in x if s in y)
        return x[: x.index(met) + 1] + y[: y.index(met)][::-1]

    def gap(a, b):
        for low, high in ((a, b), (b, a)):
            if high in chain(low):
                i, total = root[low], 0.0
                while name[i] != high:
                    total, i = total + t.length[i], t.parent[i]
                return total
        return t.depth[root[a]] + t.depth[root[b]] - 2 * t.depth[t.mrca([root[a], root[b]])]

    hosts, out = sorted(set(host.values()) - {K.UNASSIGNED}), []
    for h1, h2 in itertools.combinations(hosts, 2):
        one, two = ([s for s in host if host[s] == h] for h in (h1, h2))
        inner = {(a, b): [host[s] for s in path(a, b)[1:-1]] for a in one for b in two}
        adjacent = any(x in ([], [K.UNASSIGNED]) for x in inner.values())
        contiguous = all(set(x) <= {h1, h2, K.UNASSIGNED} for x in inner.values())
        best = min((gap(a, b) for (a, b), x in inner.items() if not {h1, h2} & set(x)), default=np.inf)
        c12 = sum(h1 in [host[s] for s in chain(b)[1:]] for b in two)
        c21 = sum(h2 in [host[s] for s in chain(a)[1:]] for a in one)
        tips = [sum(h == x for x in t.host) or 1 for h in (h1, h2)]
        out.append((h1, h2, adjacent, contiguous, c12, c21, len(one), len(two), K.ancestry_class(c12, c21, len(one), len(two), *tips), best))
    return out


@pytest.mark.parametrize("at_once", [3, 200_000])
def test_pairs_against_plain_loops(monkeypatch, at_once):
    monkeypatch.setattr(K, "PAIRS", at_once)
    several = 0
    for seed in range(150):
        t = tree(seed, "ABCDE", 24)
        rng = random.Random(seed)
        state = [t.host[i] or K.UNASSIGNED if t.tip[i] else rng.choice([*"ABCDE", K.UNASSIGNED]) for i in range(len(t.id))]
        for i in t.down:  # regions of several nodes
            if t.parent[i] >= 0 and not t.tip[i] and rng.random() < 0.6:
                state[i] = state[t.parent[i]]
        name, first = K.splits(t, state)
        rows = K.collapsed(t, name, first, state)
        got, want = K.classified(rows, t, name), loops(rows, t, name)
        assert [r[:9] for r in got] == [r[:9] for r in want]
        assert np.allclose([r[9] for r in got], [r[9] for r in want])
        several += sum(r[6] > 1 and r[7] > 1 for r in want)
    assert several > 100


def test_common_ancestors():
    for seed in range(30):
        t = tree(seed, n=30)
        a, b = (np.array(x) for x in zip(*itertools.product(range(len(t.id)), repeat=2)))
        assert K.Ancestry(t).common(a, b).tolist() == [t.mrca([x, y]) for x, y in zip(a.tolist(), b.tolist())]
    one = K.Tree([5], [None], [0.0], ["A"])
    assert K.Ancestry(one).common(np.array([0]), np.array([0])).tolist() == [0]


def test_ancestry_table():
    f = K.ancestry_class
    assert f(0, 0, 1, 1, 1, 1) == "noAncestry" and f(1, 0, 1, 1, 1, 1) == "anc" and f(0, 1, 1, 1, 1, 1) == "desc"
    assert f(2, 0, 1, 2, 1, 9) == "complex" and f(2, 0, 1, 2, 1, 9, allow_multi=True) == "multiAnc" and f(3, 0, 1, 3, 1, 9, allow_multi=True) == "complex"
    assert f(1, 0, 1, 2, 1, 9) == "complex" and f(1, 0, 1, 2, 1, 9, relaxed=True) == "anc" and f(1, 1, 1, 1, 1, 1) == "complex"
    assert f(2, 0, 1, 2, 1, 4, allow_multi=True, p_mt=0.5) == "complex"


def test_majority():
    t = K.Tree([0, 1, 2, 3, 4], [None, 0, 0, 1, 1], [0, 1, 1, 1, 1], [None, None, "B", "A", "A"])
    assert K.majority(t)[1] == "A" and K.majority(t)[0] == K.UNASSIGNED


def test_optimum_branching_against_all():
    for seed in range(60):
        rng = random.Random(seed)
        names = "abcd"
        edges = {(u, v): rng.choice([1.0, 2.0, 3.5, 5.0]) for u in names for v in names if u != v and rng.random() < 0.7}
        best = 0.0
        options = [[None, *[e for e in edges if e[1] == v]] for v in names]
        for pick in itertools.product(*options):
            chosen = [e for e in pick if e]
            up = {v: u for u, v in chosen}
            loops = False
            for v in up:
                seen = set()
                while v in up and v not in seen:
                    seen.add(v)
                    v = up[v]
                loops |= v in seen
            if not loops:
                best = max(best, sum(edges[e] for e in chosen))
        got = K.edmonds(edges)
        assert len({v for _, v in got}) == len(got) and np.isclose(sum(edges[e] for e in got), best)


def test_posterior_recovers_flows():
    obs = np.array([36.0, 4.0, 6.0, 54.0]) * 4
    flow, _, accepted = W.flow_posterior(obs, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), [np.full(50, 0.6), np.full(50, 0.6)], 400, 1)
    share = np.exp(flow) / np.exp(flow).sum(axis=1, keepdims=True)
    assert np.allclose(share.mean(axis=0), obs / obs.sum(), atol=0.03) and accepted == 1.0
    prior = [np.linspace(0.3, 0.9, 60), np.linspace(0.5, 0.7, 60)]
    flow, _, accepted = W.flow_posterior(obs, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), prior, 3000, 2, joint=True)
    share = (np.exp(flow) / np.exp(flow).sum(axis=1, keepdims=True))[500:].mean(axis=0)
    # With a rate near 0 the counts say nothing about the probabilities alone: these follow their priors.
    rng = np.random.default_rng(3)
    x, y = rng.choice(prior[0], 4000), rng.choice(prior[1], 4000)
    want = rng.gamma(obs + 0.2, size=(4000, 4)) / np.column_stack([x * x, x * y, x * y, y * y])
    assert accepted > 0.9 and np.allclose(share, (want / want.sum(axis=1, keepdims=True)).mean(axis=0), atol=0.03)
    assert 300 < W.effective_size(np.random.default_rng(1).normal(size=500)) <= 700


def test_effective_size_of_long_chains(monkeypatch):
    """As all autocorrelations give it, without finding all of them (the square of the length)."""

    def plain(x):
        x = x - x.mean()
        rho, total = [x[: len(x) - k] @ x[k:] / (x @ x) for k in range(len(x))], 0.0
        for k in range(1, len(x) - 1, 2):
            if rho[k] + rho[k + 1] <= 0:
                break
            total += rho[k] + rho[k + 1]
        return len(x) / (1 + 2 * total)

    rng = np.random.default_rng(4)
    monkeypatch.setattr(np, "correlate", None)
    for n in (4, 5, 50, 701):
        for x in (rng.normal(size=n), rng.normal(size=n).cumsum(), np.sin(np.arange(n) / 60)):
            assert np.isclose(W.effective_size(x), plain(x), rtol=1e-9)
    assert W.effective_size(rng.normal(size=2_000_000)) > 1_500_000


def test_priors_of_a_category_by_role(spark):
    """Fixed probabilities: the flows' means follow from counts over both roles' probabilities."""
    seen = {("a", "a"): 400.0, ("a", "b"): 300.0, ("b", "a"): 200.0, ("b", "b"): 100.0}
    rate = {("a", "source"): 0.8, ("a", "recipient"): 0.2, ("b", "source"): 0.4, ("b", "recipient"): 0.5}
    obs = spark.createDataFrame([(a, b, n) for (a, b), n in seen.items()], "source string, recipient string, obs double")
    prior = spark.createDataFrame([(c, w, p) for (c, w), p in rate.items()], "category string, who string, p double")
    for joint in (False, True):
        rows = W.flow_draws(obs, prior, 1, 400, joint=joint).collect()
        for (a, b), n in seen.items():
            got = np.mean([np.exp(r.value) for r in rows if (r.source, r.recipient) == (a, b)])
            assert abs(got / (n / (rate[a, "source"] * rate[b, "recipient"])) - 1) < 0.03
    both = prior.where("who = 'source'").drop("who")
    got = [np.exp(r.value) for r in W.flow_draws(obs, both, 1, 400).collect() if (r.source, r.recipient) == ("a", "b")]
    assert abs(np.mean(got) / (300 / (0.8 * 0.4)) - 1) < 0.03
    with pytest.raises(Exception, match="KeyError"):
        W.flow_draws(obs, prior.where("category = 'a' or who = 'source'"), 1, 2).collect()


def test_rooting_and_pruning_keep_distances():
    from cladewise.operators import rooting as G

    def far(rows, a, b):
        up = {}
        d, n = 0.0, a
        while n is not None:
            up[n] = d
            d, n = d + rows[n][1], rows[n][0]
        d, n = 0.0, b
        while n not in up:
            d, n = d + rows[n][1], rows[n][0]
        return d + up[n]

    for seed in range(60):
        t = tree(seed)
        rows = {t.id[i]: (None if t.parent[i] < 0 else t.id[t.parent[i]], t.length[i]) for i in range(len(t.id))}
        tips = [t.id[i] for i in range(len(t.id)) if t.tip[i]]
        new = G.rerooted(rows, tips[0])
        (root,) = [n for n, (p, _) in new.items() if p is None]
        two = [n for n, (p, _) in new.items() if p == root]
        assert len(two) == 2 and tips[0] in two
        if root not in rows:
            assert new[tips[0]][1] == rows[tips[0]][1] and sum(new[n][1] for n in two) == rows[tips[0]][1]
        less = G.pruned(new, tips[1:3])
        for x, kept in ((new, tips), (less, [n for n in tips if n not in tips[1:3]])):
            assert {n for n in x if n in tips} == set(kept)
            assert all(sum(p == n for p, _ in x.values()) != 1 for n in x)
            for a, b in itertools.combinations(kept, 2):
                assert np.isclose(far(x, a, b), far(rows, a, b))


def test_contracted_nodes_tell_where_they_went():
    from cladewise.operators import rooting as G

    rows = {1: (None, 0.0), 2: (1, 1.0), 3: (2, 2.0), 4: (3, 4.0), 5: (3, 8.0), 6: (1, 16.0), 7: (1, 32.0)}
    assert G.contracted(rows, [5, 7]) == ({1: (None, 0.0), 4: (1, 7.0), 6: (1, 16.0)}, {1: 1, 2: 4, 3: 4, 4: 4, 5: None, 6: 6, 7: None})
    assert G.contracted(rows, [4, 5, 6, 7])[0] == {}
    assert G.contracted(rows, [4, 5, 6]) == ({7: (None, 0.0)}, {1: 7, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 7})
    star = {1: (None, 0.0), 2: (1, 1.0), 3: (1, 2.0), 4: (1, 3.0)}
    assert G.rerooted(star, 2) == {5: (None, 0.0), 1: (5, 0.0), 2: (5, 1.0), 3: (1, 2.0), 4: (1, 3.0)}
    deep = {i: (i - 1 if i else None, 1.0) for i in range(20_000)}
    assert G.contracted(deep)[0] == {19_999: (None, 0.0)}


def test_roots_of_many_children_are_resolved(spark):
    from cladewise.operators import rooting as G

    nodes = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 1, 3.0), (2, 1, None, 0.0), (2, 2, 1, 1.0), (2, 3, 1, 2.0)], "tree_id long, node long, parent long, edge_length double")
    out = G.processed(nodes, spark.createDataFrame([], "tree_id long, outgroup long"))
    assert sorted((r.tree_id, r.node, r.parent, r.edge_length) for r in G.kept(out).where("parent is not null").collect()) == [(1, 1, 5, 0.0), (1, 2, 5, 1.0), (1, 3, 1, 2.0), (1, 4, 1, 3.0), (2, 2, 1, 1.0), (2, 3, 1, 2.0)]
    assert {(r.node, r.old) for r in out.where("tree_id = 1").collect()} == {(5, None), (1, 1), (2, 2), (3, 3), (4, 4)}


def test_closures_of_deep_trees_are_whole(spark):
    n = 100  # a caterpillar: deeper than 64
    rows = [(0, i, i - 1 if i else None, 0.001 if 0 < i < n - 1 else 1.0, i == n - 1, "A", 1) for i in range(n)]
    rows += [(0, n, 0, 1.0, True, "A", 1)]
    nodes = spark.createDataFrame(rows, "tree_id long, node long, parent long, edge_length double, is_tip boolean, host string, reads long")
    up = T.closure(nodes)
    assert up.count() == n * (n + 1) // 2 + 2
    assert T.depths(nodes).agg(F.max("level")).first()[0] == n - 1
    assert sorted((r.host, r.node, r.mrca, round(r.dist, 9)) for r in T.to_mrca(nodes, nodes.where("is_tip").select("tree_id", "host", "node"), "host").collect()) == [("A", n - 1, 0, round(0.001 * (n - 2) + 1, 9)), ("A", n, 0, 1.0)]
    assert [(r.node, r.host, r.tips) for r in T.host_clades(nodes).collect()] == [(0, "A", 2)]
    assert [tuple(r) for r in T.mrca(up, nodes.where("is_tip").select("tree_id", "host", "node"), "host").collect()] == [(0, "A", 0, 2)]
    assert np.isclose(T.tip_distances(nodes).first().dist, 0.001 * (n - 2) + 2)
    assert sorted((r.node, r.parent) for r in T.short_branches_collapsed(nodes, 0.01).where("parent is not null").collect()) == [(n - 1, 0), (n, 0)]
    splits = spark.createDataFrame([(0, i, i - 1 if i else None, "A" if i == 0 else "B" if i == 39 else "unassigned") for i in range(40)], "tree_id long, split long, parent_split long, host string")
    assert [(r.host_1, r.host_2, r.paths, r.nodes) for r in T.split_paths(splits).collect()] == [("A", "B", 1, 1)]


def test_a_ring_is_an_error(spark):
    nodes = spark.createDataFrame([(0, i, (i + 1) % 3, 1.0) for i in range(3)], "tree_id long, node long, parent long, edge_length double")
    with pytest.raises(ValueError):
        T.closure(nodes)

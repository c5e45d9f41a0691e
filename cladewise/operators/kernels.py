"""Kernels on one tree, which are mapped over trees: arrays in post-order, no recursion.

Ties that are random elsewhere are broken by order of the hosts here, so results don't depend on partitioning.
"""

from __future__ import annotations

from copy import copy

import numpy as np

UNASSIGNED = "unassigned"
#: Pairs of subgraphs that are looked at together.
PAIRS = 200_000
#: Numbers (a node for a host above its tips) that are gone through together.
NUMBERS = 1_000_000


class Tree:
    """node ids, parents (None at the root), edge lengths, hosts of tips (None: no host), weights of tips."""

    def __init__(self, node: list, parent: list, length: list[float], host: list[str | None], weight: list[float] | None = None) -> None:
        self.id = list(node)
        at = {n: i for i, n in enumerate(self.id)}
        self.parent = [-1 if p is None or p != p else at[p] for p in parent]
        self.length = [0.0 if x is None or x != x else float(x) for x in length]
        self.children: list[list[int]] = [[] for _ in self.id]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)
        order, stack = [], [i for i, p in enumerate(self.parent) if p < 0]
        self.roots = list(stack)
        while stack:
            i = stack.pop()
            order.append(i)
            stack.extend(self.children[i])
        self.down = order  # parents before children
        self.up = order[::-1]
        self.tip = [not c for c in self.children]
        self.host = [h if self.tip[i] and h is not None and h == h else None for i, h in enumerate(host)]
        self.hosts = sorted({h for h in self.host if h is not None}) + [UNASSIGNED]
        self.weight = [1.0 if w is None or w != w else float(w) for w in (weight or [1.0] * len(self.id))]
        self.depth = [0.0] * len(self.id)
        for i in self.down:
            if self.parent[i] >= 0:
                self.depth[i] = self.depth[self.parent[i]] + self.length[i]

    def of_host(self, host: str) -> Tree:
        """The same tree in which only that host's tips have a host."""
        out = copy(self)
        out.host, out.hosts = [h if h == host else None for h in self.host], [host, UNASSIGNED]
        return out

    def ancestors(self, i: int) -> list[int]:
        """The node itself, its parent, and so on."""
        out = [i]
        while self.parent[out[-1]] >= 0:
            out.append(self.parent[out[-1]])
        return out

    def mrca(self, nodes: list[int]) -> int:
        common = self.ancestors(nodes[0])
        for n in nodes[1:]:
            own = set(self.ancestors(n))
            common = [x for x in common if x in own]
        return common[0]

    def subtree_costs(self) -> np.ndarray:
        """For each node and host the branch length under the node that leads to the host's tips; infinite without one."""
        out = np.full((len(self.id), len(self.hosts)), np.inf)
        for i in self.up:
            if self.tip[i]:
                if self.host[i] is not None:
                    out[i, self.hosts.index(self.host[i])] = 0
            else:
                for c in self.children[i]:
                    own = out[c] + self.length[c]
                    out[i] = np.where(np.isinf(own), out[i], np.where(np.isinf(out[i]), own, out[i] + own))
        return out


class Ancestry:
    """Common ancestors of many pairs of nodes at once: minima over ranges of the pre-order, in tables of n log n numbers."""

    def __init__(self, t: Tree) -> None:
        n, parent = len(t.id), np.array(t.parent, np.int64)
        self.order = np.array(t.down, np.int64)
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        level = np.zeros(n, np.int64)
        for i in t.down:
            if parent[i] >= 0:
                level[i] = level[parent[i]] + 1
        self.level = level
        # Between two nodes in pre-order, the highest parent is their common ancestor.
        above = parent[self.order]
        tables = [np.where(above >= 0, (level[above]) * n + self.place[above], -1)]
        step = 1
        while 2 * step <= n:
            low = tables[-1]
            tables.append(np.minimum(low[: len(low) - step], low[step:]))
            step *= 2
        self.tables, self.n = tables, n

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lowest common ancestors of a[i] and b[i]."""
        x, y = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        out, wide = a.copy(), y - x
        k = np.zeros(len(wide), np.int64)
        k[wide > 0] = np.log2(wide[wide > 0]).astype(np.int64)
        for j, table in enumerate(self.tables):
            some = np.flatnonzero((k == j) & (wide > 0))
            low = np.minimum(table[x[some] + 1], table[y[some] + 1 - (1 << j)])
            out[some] = self.order[low % self.n]
        return out


class Costs:
    """What method s knows of a node: its hosts (the tips' below it), the least cost of each as the node's state, the branch length that leads to its tips, and `rest`, the cost of unassigned and of all other hosts."""

    __slots__ = ("cost", "hosts", "own", "rest")

    def __init__(self, hosts: np.ndarray, cost: np.ndarray, own: np.ndarray, rest: float) -> None:
        self.hosts, self.cost, self.own, self.rest = hosts, cost, own, rest

    def paid(self, weight: float, k: float) -> np.ndarray:
        """The cost of each host with what a change to it costs."""
        return self.cost + weight + (k * self.own if k else 0.0)


def parsimony(t: Tree, k: float = 0.0) -> list[Costs]:
    """Method s: the least cost of each state at each node. A change to a host costs the tip's weight (1 inside) and k times the subtree cost; a change to unassigned is free.

    A node holds numbers for the hosts below it only: any other host costs as much as unassigned, and never less
    as a change.
    """
    number = {h: x for x, h in enumerate(t.hosts)}
    none, at = np.zeros(0), np.zeros(0, np.int64)
    out: list[Costs] = [Costs(at, none, none, 0.0)] * len(t.id)
    for i in t.up:
        if t.tip[i]:
            if t.host[i] is not None:
                out[i] = Costs(np.array([number[t.host[i]]]), np.zeros(1), np.zeros(1), np.inf)
            continue
        hosts, less, own, rest = [], [], [], 0.0
        for c in t.children[i]:
            x = out[c]
            # Whatever the state above is, below comes at most what unassigned or the best change costs.
            most = min(x.rest, float(x.paid(t.weight[c] if t.tip[c] else 1.0, k).min(initial=np.inf)))
            rest += most
            hosts.append(x.hosts)
            less.append(np.minimum(x.cost, most) - most)
            own.append(x.own + t.length[c])
        found, place = np.unique(np.concatenate(hosts), return_inverse=True)
        add = lambda values: np.bincount(place, weights=np.concatenate(values), minlength=len(found))  # noqa: B023, E731
        out[i] = Costs(found, rest + add(less), add(own), rest)
    return out


def trace(t: Tree, costs: list[Costs], k: float = 0.0, p: float = 0.0) -> list[str]:
    """States from the root, which is unassigned: the cheapest; of unassigned and the parent's state, the first on branches over p; other ties by order."""
    free = len(t.hosts) - 1
    state = [free] * len(t.id)
    for i in t.down:
        for c in t.children[i]:
            x, up = costs[c], state[i]
            options = x.paid(t.weight[c] if t.tip[c] else 1.0, k)
            same = np.flatnonzero(x.hosts == up)
            kept = float(x.cost[same[0]]) if len(same) else np.inf if t.tip[c] and up != free else x.rest
            options[same] = kept
            least = min(kept, x.rest, float(options.min(initial=np.inf)))
            best = sorted({*x.hosts[options == least].tolist(), *([up] if kept == least else []), *([free] if x.rest == least else [])})
            if len(best) > 1 and free in best and up in best:
                state[c] = free if t.length[c] > p else up
            else:
                state[c] = best[0]
    return [t.hosts[s] for s in state]


def _states_of_tips(t: Tree) -> np.ndarray:
    cost = np.full((len(t.id), len(t.hosts)), np.inf)
    for i in t.up:
        if t.tip[i]:
            cost[i, t.hosts.index(t.host[i]) if t.host[i] is not None else -1] = 0
    return cost


def continuation(t: Tree, k: float, p: float) -> tuple[np.ndarray, list[str]]:
    """Method f: to unassigned costs p; to the same host the branch; to another host (1/k - p) times the weight. The costs are a row of numbers for each node, one for each host."""
    n = len(t.hosts)
    cost = _states_of_tips(t)

    def options(c: int) -> tuple[np.ndarray, np.ndarray]:
        """By state below: the cost from another state above, and from the same."""
        other = cost[c] + (1 / k - p) * (t.weight[c] if t.tip[c] else 1.0)
        same = cost[c] + t.length[c]
        other[-1] = same[-1] = cost[c, -1] + p
        return other, same

    for i in t.up:
        if not t.tip[i]:
            cost[i] = 0.0
            for c in t.children[i]:
                other, same = options(c)
                # The best other state is the least but one's own.
                first = int(other.argmin())
                rest = np.full(n, other[first])
                rest[first] = np.delete(other, first).min(initial=np.inf)
                cost[i] += np.minimum(same, rest)
    state = [n - 1] * len(t.id)
    for i in t.down:
        for c in t.children[i]:
            other, same = options(c)
            other[state[i]] = same[state[i]]
            state[c] = int(np.argmin(other))
    return cost, [t.hosts[s] for s in state]


def majority(t: Tree) -> list[str]:
    """Method r: the host of most children ('*' doesn't count, ties are '*'); above its host's MRCA a node is '*'; then a '*' takes its parent's host if that is among the winners, else unassigned."""
    tips: dict[str, list[int]] = {}
    for i in t.up:
        if t.tip[i]:
            tips.setdefault(t.host[i] or UNASSIGNED, []).append(i)
    top = {h: t.mrca(v) for h, v in tips.items()}
    above = {h: set(t.ancestors(i)[1:]) for h, i in top.items()}
    state: list[str] = ["*"] * len(t.id)
    winners: list[list[str]] = [[] for _ in t.id]
    for i in t.up:
        if t.tip[i]:
            state[i] = t.host[i] or UNASSIGNED
            continue
        count: dict[str, int] = {}
        for c in t.children[i]:
            if state[c] != "*":
                count[state[c]] = count.get(state[c], 0) + 1
        best = max(count.values(), default=0)
        winners[i] = sorted(h for h, n in count.items() if n == best)
        state[i] = winners[i][0] if len(winners[i]) == 1 else "*"
        if state[i] != "*" and i in above.get(state[i], ()):
            state[i] = "*"
    for i in t.down:
        if state[i] == "*":
            up = state[t.parent[i]] if t.parent[i] >= 0 else UNASSIGNED
            state[i] = up if up in winners[i] and i not in above.get(up, ()) else UNASSIGNED
    return state


def splits(t: Tree, state: list[str]) -> tuple[list[str], list[bool]]:
    """Subgraphs: a new one where the state differs from the parent's. Hosts with several get -SPLITi, numbered in post-order; unassigned regions likewise. Also whether a node is its subgraph's first."""
    first = [t.parent[i] < 0 or state[t.parent[i]] != state[i] for i in range(len(t.id))]
    count: dict[str, int] = {}
    for i in t.up:
        if first[i]:
            count[state[i]] = count.get(state[i], 0) + 1
    number, name = dict.fromkeys(count, 0), [""] * len(t.id)
    for i in t.up:
        if first[i]:
            number[state[i]] += 1
            name[i] = state[i] if count[state[i]] == 1 and state[i] != UNASSIGNED else f"{state[i]}-SPLIT{number[state[i]]}"
    for i in t.down:
        if not first[i]:
            name[i] = name[t.parent[i]]
    return name, first


def _plain_host_subgraphs(node: list, parent: list, length: list, host: list, weight: list, k: float) -> list[tuple]:
    """host, subgraph, tip, reads of one tree, one host after the other."""
    out, whole = [], Tree(node, parent, length, host, weight)
    for h in whole.hosts[:-1]:
        t = whole.of_host(h)
        name, _ = splits(t, trace(t, parsimony(t, k), k))
        out += [(h, name[i], t.id[i], int(t.weight[i])) for i in range(len(t.id)) if t.host[i] == h]
    return out


def host_subgraphs(tree: list, node: list, parent: list, length: list, host: list, weight: list, k: float) -> tuple[list, list, list, list, list]:
    """Of many trees, whose rows are in order of trees and nodes: tree, host, subgraph, tip, reads of each tip with a host, as method s, trace and splits give them for a tree in which only that host's tips have a host.

    Only nodes with the host below them have numbers: elsewhere unassigned costs nothing and no subgraph begins.
    Trees that are no plain trees (a cycle, a node twice, a tip as root, a host called unassigned) go one by one.
    """
    n = len(node)
    start = [i for i in range(n) if not i or tree[i] != tree[i - 1]]
    of = np.repeat(np.arange(len(start)), np.diff([*start, n]))
    above, odd = np.full(n, -1, np.int64), np.zeros(len(start), bool)
    for g, (a, z) in enumerate(zip(start, [*start[1:], n])):
        at = {x: i for i, x in enumerate(node[a:z], a)}
        odd[g] = len(at) < z - a
        for i in range(a, z):
            if parent[i] is not None and parent[i] == parent[i]:
                above[i] = at[parent[i]]
    child = np.flatnonzero(above >= 0)
    inner = np.zeros(n, bool)
    inner[above[child]] = True
    level = np.where(above < 0, 0, -1)
    by_parent = child[np.argsort(above[child], kind="stable")]  # a node's children are neighbours, in order
    counts = np.bincount(above[child], minlength=n)
    begin = np.cumsum(counts) - counts

    def below(some: np.ndarray) -> np.ndarray:
        """The children of nodes, node by node."""
        many = counts[some]
        return by_parent[np.repeat(begin[some] - np.cumsum(many) + many, many) + np.arange(many.sum())]

    levels = [np.flatnonzero(above < 0)]
    while len(kids := below(levels[-1])):
        level[kids] = len(levels)
        levels.append(kids)
    odd[of[level < 0]] = True
    has = np.array([h is not None and h == h for h in host], bool) & ~inner
    odd[of[has & (above < 0)]] = True
    odd[of[[i for i in np.flatnonzero(has).tolist() if host[i] == UNASSIGNED]]] = True
    # Places in post-order.
    size = np.ones(n, np.int64)
    for x in levels[:0:-1]:
        np.add.at(size, above[x], size[x])
    place = np.zeros(n, np.int64)  # of the first node of a subtree
    for x in levels:
        before = np.cumsum(size[x]) - size[x]
        if x is levels[0]:
            place[x] = before
        else:
            new = np.r_[True, above[x][1:] != above[x][:-1]]
            place[x] = place[above[x]] + before - before[new][np.cumsum(new) - 1]
    place += size - 1
    length_ = np.array([0.0 if x is None or x != x else float(x) for x in length])
    own_weight = np.array([1.0 if w is None or w != w else float(w) for w in weight])
    change = np.where(inner, 1.0, own_weight)

    tips = np.flatnonzero(has & ~odd[of])
    number: dict[tuple, int] = {}
    unit = np.array([number.setdefault((of[i], host[i]), len(number)) for i in tips.tolist()], np.int64)
    name: list[str] = [""] * len(tips)
    # A part is some (tree, host) whose nodes are at most so many numbers, or one that has more.
    order = np.argsort(unit, kind="stable")
    tips, unit = tips[order], unit[order]
    bound = np.minimum(np.bincount(unit, weights=level[tips] + 1.0), np.bincount(of)[[g for g, _ in number]] if number else 0.0)
    part = (np.cumsum(bound) // NUMBERS).astype(np.int64)
    for one in np.unique(part).tolist():
        mine = np.flatnonzero(part[unit] == one)
        for i, x in zip(mine.tolist(), _subgraph_names(tips[mine], unit[mine], above, level, length_, change, place, k, [h for _, h in number])):
            name[i] = x
    found = [(tree[i], host[i], x, node[i], int(own_weight[i])) for i, x in zip(tips.tolist(), name)]
    for g in np.flatnonzero(odd).tolist():
        a, z = start[g], [*start, n][g + 1]
        found += [(tree[a], *x) for x in _plain_host_subgraphs(*(c[a:z] for c in (node, parent, length, host, weight)), k)]
    return tuple(map(list, zip(*found))) if found else ([], [], [], [], [])


def _subgraph_names(tips: np.ndarray, unit: np.ndarray, above: np.ndarray, level: np.ndarray, length: np.ndarray, change: np.ndarray, place: np.ndarray, k: float, hosts: list[str]) -> list[str]:
    """The subgraph of each tip. A number stands for a unit (a host in a tree) and a node: unit * nodes + node."""
    n, deepest = len(above), int(level[tips].max(initial=0))
    own_keys, at = unit * n + tips, level[tips]
    state: list[tuple] = []  # from the deepest level up: keys, cost, paid, rest, where the parent is in the next level
    keys = np.zeros(0, np.int64)
    cost = own = rest = np.zeros(0)
    for x in range(deepest, -1, -1):
        # What comes from below, and the tips of this level.
        keys, cost, own, rest = (np.concatenate(pair) for pair in ((keys, own_keys[at == x]), (cost, np.zeros((at == x).sum())), (own, np.zeros((at == x).sum())), (rest, np.full((at == x).sum(), np.inf))))
        order = np.argsort(keys)
        keys, cost, own, rest = keys[order], cost[order], own[order], rest[order]
        node = keys % n
        paid = cost + change[node] + (k * own if k else 0.0)
        if not x:
            state.append((keys, cost, paid, rest, None))
            break
        most = np.minimum(rest, paid)
        less, longer = np.minimum(cost, most) - most, own + length[node]
        up, to = np.unique(keys - node + above[node], return_inverse=True)
        state.append((keys, cost, paid, rest, to, up))
        rest = np.bincount(to, weights=most, minlength=len(up))
        cost, own, keys = rest + np.bincount(to, weights=less, minlength=len(up)), np.bincount(to, weights=longer, minlength=len(up)), up
    # Down: who has the host's state, and the node at which its subgraph begins. The root is unassigned.
    top = np.full(len(state[-1][0]), -1, np.int64)
    tops, begun = np.full(len(tips), -1, np.int64), []
    for x, (keys, cost, paid, rest, to, up) in enumerate(state[-2::-1], 1):
        parents = top[np.searchsorted(state[len(state) - x][0], up)][to]
        within = parents >= 0
        held = np.where(within, (cost < rest) | (cost == rest) & ~(length[keys % n] > 0), paid < rest)
        top = np.where(held, np.where(within, parents, keys), -1)
        begun.append(keys[held & ~within])
        mine = np.flatnonzero(at == x)
        tops[mine] = top[np.searchsorted(keys, own_keys[mine])]
    first = np.concatenate(begun) if begun else np.zeros(0, np.int64)
    first = first[np.lexsort((place[first % n], first // n))]
    whose = first // n
    many = np.bincount(whose, minlength=len(hosts))
    rank = np.arange(len(first)) - (np.cumsum(many) - many)[whose] + 1
    label = {key: hosts[u] if many[u] == 1 else f"{hosts[u]}-SPLIT{r}" for key, u, r in zip(first.tolist(), whose.tolist(), rank.tolist())}
    return [label[key] for key in tops.tolist()]


def collapsed(t: Tree, name: list[str], first: list[bool], state: list[str]) -> list[tuple[str, str | None, str, str | None, float, object]]:
    """Subgraphs as nodes: split, parent split, host, parent's host, length of the branch above, root node."""
    out = []
    for i in t.down:
        if first[i]:
            p = t.parent[i]
            out.append((name[i], name[p] if p >= 0 else None, state[i], state[p] if p >= 0 else None, t.length[i], t.id[i]))
    return out


def ancestry_class(c12: int, c21: int, nodes1: int, nodes2: int, tips1: int, tips2: int, allow_multi: bool = False, n_mt: float = 3, p_mt: float = float("inf"), relaxed: bool = False) -> str:
    """c12: subgraphs of host 2 that descend from host 1; c21 likewise."""
    if not c12 and not c21:
        return "noAncestry"
    for c, other, nodes, tips, one, many in ((c12, c21, nodes2, tips2, "anc", "multiAnc"), (c21, c12, nodes1, tips1, "desc", "multiDesc")):
        if c and not other and (relaxed or c == nodes):
            if c == 1:
                return one
            if not allow_multi:
                return "complex"
            return "complex" if (c / tips >= p_mt if p_mt <= 1 else c >= n_mt) else many
    return "complex"


def classified(rows: list[tuple[str, str | None, str, str | None, float, object]], t: Tree, name: list[str], **options) -> list[tuple]:
    """Every pair of hosts of a collapsed tree: host_1, host_2, adjacent, contiguous, paths12, paths21, nodes1, nodes2, ancestry, min_dist.

    What lies between two subgraphs is counted by host: hosts on the way from the root to each, less twice those to
    where the ways part. The arrays have a row for each subgraph, and a number for each two of them.
    """
    number = {r[0]: k for k, r in enumerate(rows)}  # parents before children
    regions = Tree([r[0] for r in rows], [r[1] for r in rows], [0.0] * len(rows), [None] * len(rows))
    kinds = [*sorted({r[2] for r in rows} - {UNASSIGNED}), UNASSIGNED]
    of = np.array([kinds.index(r[2]) for r in rows])
    at = {n: i for i, n in enumerate(t.id)}
    root = np.array([at[r[5]] for r in rows])
    up = np.array([-1 if r[1] is None else number[r[1]] for r in rows])
    n, n_hosts, depth = len(rows), len(kinds) - 1, np.array(t.depth)
    # How often each host occurs from the root down to a subgraph, itself included.
    on = np.zeros((n, len(kinds)), np.int64)
    for k in range(n):
        if up[k] >= 0:
            on[k] = on[up[k]]
        on[k, of[k]] += 1
    # For a subgraph and one above it: the child of the upper one through which the way leads.
    through = np.full((n, n), -1, np.int64)
    for k in range(n):
        if up[k] >= 0:
            through[k] = through[up[k]]
            through[k, up[k]] = k
    index, nodes = Ancestry(regions), Ancestry(t)
    adjacent, apart = np.zeros((n_hosts, n_hosts), bool), np.zeros((n_hosts, n_hosts), bool)
    least = np.full((n_hosts, n_hosts), np.inf)
    above = np.array([depth[t.parent[i]] if t.parent[i] >= 0 else 0.0 for i in root.tolist()])
    # Subgraphs in order of their hosts: a subgraph is paired with all of later hosts, so many of them at a time.
    hosts = np.argsort(of, kind="stable")[: int((of < n_hosts).sum())]
    later = len(hosts) - np.searchsorted(of[hosts], of[hosts], side="right")
    first, count = 0, np.concatenate([[0], np.cumsum(later)])
    while first < len(hosts) and count[-1] > count[first]:
        stop = max(first + 1, int(np.searchsorted(count, count[first] + PAIRS, side="right")) - 1)
        times = later[first:stop]
        mine = np.repeat(hosts[first:stop], times)
        b = hosts[np.repeat(len(hosts) - times, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        first = stop
        if not len(b):
            continue
        met = index.common(mine, b)

        def between(h: np.ndarray | int, own: int) -> np.ndarray:
            return on[mine, h] + on[b, h] - 2 * on[met, h] + (of[met] == h) - own  # noqa: B023

        inner = index.level[mine] + index.level[b] - 2 * index.level[met] - 1
        free, own, other = between(n_hosts, 0), between(of[mine], 1), between(of[b], 1)
        np.logical_or.at(adjacent, (of[mine], of[b]), (inner == 0) | (inner == 1) & (free == 1))
        np.logical_or.at(apart, (of[mine], of[b]), own + other + free < inner)
        # Nested: from the lower one's root to the upper one; else between the roots.
        low, high = np.where(met == mine, b, mine), np.where(met == mine, mine, b)
        within = (met == mine) | (met == b)
        gap = np.where(within, depth[root[low]] - above[np.where(within, through[low, high], 0)], 0.0)
        beside = ~within
        gap[beside] = depth[root[mine[beside]]] + depth[root[b[beside]]] - 2 * depth[nodes.common(root[mine[beside]], root[b[beside]])]
        open_ = (own == 0) & (other == 0)
        np.minimum.at(least, (of[mine[open_]], of[b[open_]]), gap[open_])
    # Subgraphs of a host (column) that have an ancestor of another (row).
    below = np.array([(on[of == h] > 0).sum(axis=0) for h in range(n_hosts)]).reshape(n_hosts, -1).T
    size = np.bincount(of, minlength=len(kinds))
    tips: dict[str, int] = {}
    for h in t.host:
        if h is not None:
            tips[h] = tips.get(h, 0) + 1
    out = []
    for x, h1 in enumerate(kinds[:-1]):
        for y in range(x + 1, n_hosts):
            h2, c12, c21, n1, n2 = kinds[y], int(below[x, y]), int(below[y, x]), int(size[x]), int(size[y])
            kind = ancestry_class(c12, c21, n1, n2, tips.get(h1, 1), tips.get(h2, 1), **options)
            out.append((h1, h2, bool(adjacent[x, y]), not apart[x, y], c12, c21, n1, n2, kind, float(least[x, y])))
    return out


def edmonds(edges: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    """The branching of the largest weight: at most one edge into each node and no cycle. Ties by names."""
    chosen: dict[str, tuple[str, str]] = {}
    for (u, v), w in sorted(edges.items()):
        if u != v and w > 0 and (v not in chosen or w > edges[chosen[v]]):
            chosen[v] = (u, v)
    cycle: list[str] = []
    for start in sorted(chosen):
        seen, v = [], start
        while v in chosen and v not in seen:
            seen.append(v)
            v = chosen[v][0]
        if v in seen:
            cycle = seen[seen.index(v) :]
            break
    if not cycle:
        return set(chosen.values())
    inside, merged = set(cycle), "|".join(sorted(cycle))
    least = min(edges[chosen[v]] for v in cycle)
    smaller: dict[tuple[str, str], float] = {}
    origin: dict[tuple[str, str], tuple[str, str]] = {}
    for (u, v), w in sorted(edges.items()):
        a, b = (merged if u in inside else u), (merged if v in inside else v)
        if a == b:
            continue
        w = w - edges[chosen[v]] + least if v in inside else w
        if w > smaller.get((a, b), float("-inf")):
            smaller[a, b], origin[a, b] = w, (u, v)
    found = {origin[e] for e in edmonds(smaller)}
    entry = next((v for _, v in found if v in inside), None)
    if entry is None:  # the cycle opens at its weakest edge
        entry = min(cycle, key=lambda v: (edges[chosen[v]], v))
    return found | {chosen[v] for v in cycle if v != entry}

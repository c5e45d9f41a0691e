import random

import numpy as np
import pytest

from cladewise.llm import suffix


def brute(texts, least):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - least + 1):
            seen.setdefault(t[p : p + least], []).append((i, p))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p : p + least] = True
    return cover


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde é\n") for _ in range(rng.choice([30, 60, 90, 200]))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = ["".join(rng.choice("abcde ñ") for _ in range(rng.randrange(80))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages)[rng.randrange(5) :])
        if rng.random() < 0.2:
            parts.append("xyz" * rng.randrange(40))
        out.append("".join(parts))
        if rng.random() < 0.3:
            i = rng.randrange(len(out[-1]) + 1)
            out.append(out[-1][:i] + rng.choice(["", "q"]) + out[-1][i:])
    return out


def test_groups_are_maximal_with_all_occurrences():
    for seed in range(8):
        rng = random.Random(seed)
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(40))) for _ in range(6)]
        least, want = 4, {}
        for i, t in enumerate(texts):
            for p in range(len(t)):
                for q in range(p + least, len(t) + 1):
                    want.setdefault(t[p:q], set()).add((i, p))
        maximal = {}
        for s, places in want.items():
            left = {texts[i][p - 1 : p] if p else (i, p) for i, p in places}
            right = {texts[i][p + len(s) : p + len(s) + 1] if p + len(s) < len(texts[i]) else (i, p) for i, p in places}
            if len(places) > 1 and (len(left) > 1) and (len(right) > 1):
                maximal[s] = sorted(places)
        got = dict(suffix.maximal_repeats(texts, least))
        assert {k: v for k, v in got.items() if k in maximal} == maximal
        # A string's start counts as a different left neighbour of its own, so a few more groups may come.
        assert all(sorted(want[k]) == v for k, v in got.items())


@pytest.mark.parametrize("hot", [1000, 3])
def test_against_brute_force(spark, hot):
    texts = [*corpus(), None, "", "a" * 39, "a" * 40, "b" * 41, "same " * 30, "same " * 30]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, anchor int").repartition(3)
    data = [(t or "").encode() for t in texts]
    want = brute(data, 40)
    got = {r.id: suffix.merged([x.asDict() for x in r.ranges or []]) for r in suffix.marked(df, least=40, gram=8, hot=hot).collect()}
    assert len(got) == len(texts)
    for i, c in enumerate(want):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(int))).reshape(-1, 2)
        assert got[i] == [tuple(map(int, e)) for e in edges], (i, texts[i])


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 50)
    monkeypatch.setattr(suffix, "chunks", lambda o: [(i, i + 1) for i in range(len(o) - 1)])
    raw = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    starts = []
    for _, place, own, at in suffix._pieces(raw, np.array([0, 300]), 40):
        _, _, _, lo, _, hi = suffix.anchors(own, at, 40, 8)
        starts += [x + place for a, b in zip(lo, hi) for x in range(a, b + 1)]
    assert starts == list(range(261))


def test_remove_keeps_characters_and_columns(spark):
    text = "é" * 30
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text[1:] + "z", "y"), (3, None, None)], "doc_id long, text string, id string")
    out = suffix.remove(df, least=41, gram=8)
    assert out.columns == df.columns and sorted((r.text or "") for r in out.collect()) == ["", "", "", "z"]
    assert suffix.remove(df.limit(0), least=41, gram=8).count() == 0


@pytest.mark.parametrize("hot", [1000, 3])
def test_two_thresholds(spark, hot):
    texts = [*corpus(), None, "", "same words here again " * 6, "x same words here again " * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    data = [(t or "").encode() for t in texts]
    long, short = brute(data, 60), brute(data, 30)
    got = {r.id: r.asDict(recursive=True) for r in suffix.marked_twice(df, 30, least=60, gram=8, hot=hot).collect()}
    assert len(got) == len(texts) and any(map(any, long)) and any(a.sum() > b.sum() for a, b in zip(map(np.array, short), map(np.array, long)))
    for i, pair in enumerate(zip(long, short)):
        for name, c in zip(("ranges", "passages"), pair):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(int))).reshape(-1, 2)
            assert suffix.merged(got[i][name]) == [tuple(map(int, e)) for e in edges], (name, texts[i])


def test_strings_without_repeats_are_left_out():
    rng = random.Random(2)
    for _ in range(200):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(5)]
        some = suffix._with_repeats(parts, 8)
        covered = suffix.Repeats(parts, 8).covered()
        assert {i for i, c in enumerate(covered) if len(c)} == set(some)

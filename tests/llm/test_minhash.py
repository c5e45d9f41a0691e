import itertools
import random
import re

import pytest

from cladewise.llm.minhash import near_duplicates


def brute(rows):
    """All pairs on full sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    least = list(range(len(rows)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    near = {p for ids in by.values() for p in itertools.combinations(ids, 2)}
    for i, j in near:
        same = len(sets[i] & sets[j])
        if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
            a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
            least[b] = a
    return [(d, len(s), rows[find(i)][0], rows[find(i)][0] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r)[:4] for r in near_duplicates(df).collect()]


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    out = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([3, 5, 30, 80]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            changed = [word() if rng.random() < rng.choice([0.005, 0.02, 0.05]) else w for w in base]
            out.append(rng.choice([" ", "\n", " \t"]).join(changed))
    chain = [word() for _ in range(60)]
    for i in range(12):  # each link holds, the ends do not
        chain[i * 5] = word()
        out.append(" ".join(chain))
    return out


def test_against_all_pairs(spark):
    rows = list(enumerate([*texts(), None, "", " \t\n", "one", "ONE", "one two three four five", "One two\tthree four five", None], 100))
    assert sorted(result(spark, rows)) == sorted(brute(rows))


@pytest.mark.parametrize(("blocks", "much"), [(4, 0), (13, 100), (4096, 100)])
def test_shared_passages_and_blocks(spark, monkeypatch, blocks, much):
    import cladewise.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK", blocks)
    monkeypatch.setattr(m, "MUCH", much)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("hijklm") for _ in range(5))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join(passage + [word() for _ in range(rng.choice([4, 9, 12, 25]))])) for i in range(60)]
    assert sorted(result(spark, rows)) == sorted(brute(rows))


def test_repeated_rows_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 9), (1, "a b c d e f", 8), (None, "a b c d e f", 7), (4, None, 6), (None, None, 5)], "doc_id long, text string, key int")
    got = sorted(map(str, near_duplicates(df).collect()))
    assert len(got) == 5
    rows = [r for r in near_duplicates(df).collect() if r.n_shingles == 2]
    assert {r.component_id for r in rows} == {1} and sorted(r.kept for r in rows) == [False, True, True]
    assert near_duplicates(df.limit(0)).count() == 0


def test_edits_of_one_text_around_the_threshold(spark, monkeypatch):
    import cladewise.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK", 40)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("nopqrst") for _ in range(5))
    base = [word() for _ in range(70)]
    rows = []
    for i in range(120):
        own = list(base)
        for k in rng.sample(range(70), rng.randrange(6)):
            own[k] = word()
        rows.append((i, " ".join(own)))
    assert len({r[2] for r in brute(rows)}) > 5
    assert sorted(result(spark, rows)) == sorted(brute(rows))


def test_null_ids_meet_their_own_texts_only(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("uvwxyz") for _ in range(5))
    one, two = ([word() for _ in range(40)] for _ in range(2))
    rows = [(None, " ".join(x[:k])) for x in (one, two) for k in (40, 39, 38, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id, r.kept, r.n_links > 0) for r in near_duplicates(df).collect()) == sorted((len(t.split()) - 4, None, False, len(t.split()) > 20) for _, t in rows)


def test_rows_of_a_hot_bucket_grow_with_its_members_only(spark):
    import cladewise.llm.minhash as m

    def rows(n):
        # One bucket of n members; two and two are alike in three quarters of their signatures.
        words = "transform(sequence(1, 32), i -> xxhash64(id div 2, i, if(i % 4 = 0, id, 0)))"
        classes = spark.range(n).selectExpr("cast(cast(id as string) as binary) as key", f"{words} as sign")
        found = m.narrowed(classes.selectExpr("7L as slot", "key"), spark.createDataFrame([], "node binary, label binary"), classes)
        meet = found.groupBy("slot").agg(m.F.collect_set(m.F.floor(m.F.col("key").cast("string").cast("long") / 2)).alias("pairs"), m.F.count("*").alias("n"))
        assert meet.where("n > size(pairs)").select(m.F.explode("pairs").alias("pair")).distinct().count() == n // 2
        return found.count()

    few, many = rows(10_000), rows(50_000)
    assert many < 8 * few and many < 96 * 50_000

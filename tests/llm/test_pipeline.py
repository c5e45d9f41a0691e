import base64
import itertools
import random

import public_tokenizers as P
import pytest
import tiktoken

from cladewise.llm import pipeline as C
from tests.llm.test_minhash import brute as near_groups


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(90))
    docs, labels = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randrange(30, 90))]
        good = rng.random() < 0.75
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        if good and rng.random() < 0.15:
            text = text + " " + passage + " " + word()
        docs.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text), good))
        labels.append((i, int(good), 0))
    for k in range(20):  # copies and near copies
        d = docs[rng.randrange(160)]
        text = d[1] if k % 2 else d[1] + " " + word()
        docs.append((1000 + k, text, "en", d[3], len(text), d[5]))
    docs.append((2000, None, "en", "a", None, None))
    return docs, labels


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels = corpus()
    spark.createDataFrame([d[:5] for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages, frame = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in C.STAGES:
        frame = C.staged(f(spark, frame, folder), "test")
        stages.append(frame)
    return spark, folder, docs, stages


def test_stages_keep_the_columns_of_documents(run):
    _, _, _, stages = run
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "mix_sources", "byte_level_bpe"]


def test_quality_stage_drops_bad_documents(run):
    _, _, docs, stages = run
    kept = {r.doc_id for r in stages[0].collect()}
    known = [d for d in docs if d[5] is not None]
    assert sum((d[0] in kept) == d[5] for d in known) / len(known) > 0.97


def test_near_stage_keeps_one_of_each_group(run):
    _, _, _, stages = run
    before = sorted((r.doc_id, r.text) for r in stages[0].collect())
    want = {d for d, _, _, kept in near_groups(before) if kept}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_passages_are_cut_out(run):
    _, _, _, stages = run
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    data = [t.encode() for t in before.values() if t]
    n, seen, twice = C.PASSAGE_BYTES, set(), set()
    for t in data:
        for p in range(len(t) - n + 1):
            (twice if t[p : p + n] in seen else seen).add(t[p : p + n])
    assert twice
    cut = 0
    for d, t in before.items():
        if t is None:
            continue
        raw = t.encode()
        cover = [False] * len(raw)
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in twice:
                cover[p : p + n] = [True] * n
        want, at = b"", 0
        for same, run_ in itertools.groupby(cover):
            size = len(list(run_))
            piece = raw[at : at + size]
            long = same and len(piece.split()) >= C.PASSAGE_WORDS
            want, at, cut = want + (b"" if long else piece), at + size, cut + long
        assert after.get(d, ("", 0))[0] == want.decode() and after.get(d, ("", 0))[1] == len(want.decode())
    assert cut > 5


def test_mix_and_ids(run):
    _, _, _, stages = run
    mixed = sorted(r.doc_id for r in stages[3].collect())
    ids = stages[4].collect()
    assert sorted(r.doc_id for r in ids) == mixed and max(map(mixed.count, mixed)) <= 2
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in stages[2].collect()}
    assert all(r.ids == library.encode_ordinary(text[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in ids)


def test_long_texts_and_a_table_without_words(spark, run):
    _, folder, _, _ = run
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(60_000)) + "."
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, None, None, None, None), (3, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in C.byte_level_bpe(spark, C.mix_sources(spark, C.suffix_array_dedup(spark, docs, folder), folder), folder).collect()}
    assert set(got) == {1} and got[1].n_tokens > 60_000
    assert {r.doc_id: r.n_tokens for r in C.byte_level_bpe(spark, docs, folder).collect()} == {1: got[1].n_tokens, 2: 0, 3: 0}


def test_stages_take_empty_tables_and_clashing_columns(run):
    spark, folder, _, _ = run
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as score", "2 as id", "'k' as key", "3 as kept", "4 as row", "5 as size")
    for name, f in C.STAGES:
        assert f(spark, docs.limit(0), folder).count() == 0
    assert C.minhash_near_dedup(spark, docs.limit(5), folder).columns == docs.columns
    assert C.mix_sources(spark, docs.limit(5), folder).columns == docs.columns
    assert C.suffix_array_dedup(spark, docs.limit(5), folder).columns == docs.columns

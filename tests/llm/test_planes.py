import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cladewise.llm import planes

PATH = P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    out = [None, "", " \n", "It's <|endoftext|> x<|startoftext|>", "Á a ́e", "ΣΑΣ İI", "don't WE'LL 'tis", "1234,567 x.y", "x" * 5000, "a\x1cb\x85c\xa0d", "Straße ÀÉ«»×÷ñ", "日本 🙂"]
    for _ in range(200):
        out.append("".join(rng.choice(["The", "ING", " ", " ", "\n", "ß", "É", "7", "'s", "'", "<", "!!", "*", "tion", "　", "é", "×"]) for _ in range(rng.randrange(50))))
    return out


def want(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip_of_a_shard(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 64, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        shard = planes.Shard(planes.write_shard([5, None], [n, 0], ids, block=64, bits=bits))
        assert np.array_equal(shard.ids(), ids) and shard.counts.tolist() == [n, 0] and shard.doc_ids[0] == 5
        if n > 64:
            assert np.array_equal(shard.read_block(1), ids[64:128])


def test_as_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    own = planes.encoder(PATH, 2)
    for n in (1, 7, 10_000):
        some = texts()
        for at in range(0, len(some), n):
            ids, size = own.encode(pa.array(some, pa.string()).slice(at, n))
            got = np.split(ids, np.cumsum(size)[:-1])
            assert [x.tolist() for x in got] == [want(tokenizer, t) for t in some[at : at + n]]


def test_a_full_cache_is_given_up(monkeypatch):
    monkeypatch.setattr(planes, "CACHE", 3)
    own = planes.Encoder(PATH, 2)
    for t in texts()[:60]:
        assert own.encode(pa.array([t], pa.string()))[0].tolist() == want(own.tokenizer, t)


@pytest.mark.parametrize("bits", [False, True])
def test_files(spark, bits):
    tokenizer = Tokenizer.from_file(PATH)
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i * 3 - 50, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    got = {r.doc_id: tuple(r) for r in planes.read(planes.write(df, PATH, block=16, shard=100, bits=bits)).collect()}
    start = 0
    for i, t in enumerate(texts()):
        ids = want(tokenizer, t)
        assert got[i * 3 - 50] == (i * 3 - 50, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_edges(spark):
    df = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (1, None)], "doc_id long, text string")
    out = sorted((tuple(r) for r in planes.read(planes.write(df, PATH)).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None, 1, 1, 1] and [r[1] for r in out] == [0, 2, 3, 5]
    assert planes.read(planes.write(df.limit(0), PATH)).count() == 0

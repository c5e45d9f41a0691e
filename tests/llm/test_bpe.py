import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from cladewise.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n\n  x", "a\x1cb\x1f c", "don't we'll  I'm", "<|endoftext|> x", "x" * 700, "é" * 300 + "!" * 90, "日本語 текст 🙂🙂    z", "a  \n b\t\tc \r\n"]
    for _ in range(300):
        out.append("".join(rng.choice(["the", "ing", " ", "  ", "\n", "Q", "ß", "é", "1", "23", "'s", "!!", "|", "*", "tion", "　", "\x1d", "🙂"]) for _ in range(rng.randrange(60))))
    return out


def test_as_the_library(library):
    own = bpe.encoder(PATH, P.PATTERN)
    for t, x in zip(texts(), own.encode(texts())):
        ids = x.tolist()
        assert ids == library.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "").encode()


def test_single_trees_as_rows(library):
    own = bpe.encoder(PATH, P.PATTERN).vocabulary
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"etaoinshr*") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    assert own.merged_all(pieces) == [np.array(own.merged(p), np.int32).tobytes() for p in pieces]


def test_frames(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, ids int").repartition(3)
    ids = bpe.encode(df, PATH, P.PATTERN)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts())}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, PATH, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts())}
    for r in bpe.digests(df, PATH, P.PATTERN).collect():
        assert r.n_tokens == len(got[r.doc_id]) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, got[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back[r.doc_id]).hexdigest()
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cladewise.llm import packing, segments
from cladewise.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(5)
    out = [None, "", " ", " \n", "It's <|endoftext|> x<|endoftext|>y", "a <|endoftext|>", "a  b\n\n c\t d \r\n", "  lead", "don't WE'LL 'tis it.'s", "a\x1c b\x85 c\xa0 d　 e  f \n", "é. ù, ×. ÷, «a»!", "x" * 3000, "日本。 🙂 ok", "1234,567 x.y (z)"]
    parts = ["The", "ing", " ", " ", "\n", "\t", "\r", "é", "7", "'s", "'", "<|endoftext|>", "<|", "!!", ".", ",", "|", "　", "\xa0", " ", "×", "’", "\x85", "᠎", "‘", "»"]
    for _ in range(400):
        out.append("".join(rng.choice(parts) for _ in range(rng.randrange(40))))
    return out


@pytest.mark.parametrize("step", [1, 9, 1000])
def test_segments_are_encoded_as_whole_texts(step):
    own, library = segments.byte_level_encoder(PATH), Tokenizer.from_file(PATH)
    some = texts()
    for at in range(0, len(some), step):
        ids, counts = own.encode(pa.array(some, pa.string()).slice(at, step))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in some[at : at + step]]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_a_full_cache_is_given_up(monkeypatch):
    monkeypatch.setattr(segments, "CACHE", 2)
    library = Tokenizer.from_file(PATH)
    own = segments.Encoder(lambda some: [library.encode(s, add_special_tokens=False).ids for s in some], True)
    for t in texts()[:40]:
        assert own.encode(pa.array([t], pa.string()))[0].tolist() == library.encode(t or "", add_special_tokens=False).ids


def held(pieces, want, size):
    """Pieces against the ids that every row has; gives the padding."""
    rows = pieces.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, ids in want.items():
        own = sorted(by_doc[doc], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == ids
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(ids)}
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([0, *(r.length for r in own)]).tolist()
        assert [r.offset for r in own] == ends[:-1] and ends[-1] <= size
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else size - ends[-1]
    return padding


@pytest.mark.parametrize(("partitions", "group", "spaces"), [(1, 64, 4), (7, 2, 3), (5, 64, 1)])
def test_packing(spark, partitions, group, spaces):
    library = Tokenizer.from_file(PATH)
    some = dict(enumerate(texts()))
    some[None] = "no id"
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in some.items()], "doc_id long, text string, start string, length int").repartition(partitions)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in some.items()}
    out = packing.pack(df, PATH, size=64, spaces=spaces, least=4, group=group)
    padding = held(out, want, 64)
    assert padding < 0.03 * sum(map(len, want.values()))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, packing.pack(df, PATH, size=64, spaces=spaces, least=4, group=group).collect()), key=str)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, PATH).collect()
    assert sum(r.length for r in rows) == 7 and sum(r.length for r in rows if r.id == 1) == 6
    assert {r.doc_tokens for r in rows if r.id == 1} == {3}
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_powers_of_two():
    window = [packing.Piece(5, "a", 0, 5, np.arange(5)), packing.Piece(2, "b", 3, 9, np.arange(2))]
    assert [[(p.doc, p.start, p.length) for p in s] for s in packing.powers_of_two(window)] == [[("a", 0, 4)], [("a", 4, 1), ("b", 3, 1)], [("b", 4, 1)]]


def test_best_fit_and_the_fullest_first():
    packer = packing.Packer(10, 2, 2)
    for n in (6, 7, 3):  # 3 fits 7's window best and fills it
        packer.add(packing.Piece(n, n, 0, n, np.arange(n)))
    assert [[p.doc for p in w] for w in packer.given_out()] == [[7, 3]]
    for n in (9, 8):  # 6 and 9 are open; 8 fits nowhere: 9's gap of 1 stays, 8 gets a window
        packer.add(packing.Piece(n, n, 0, n, np.arange(n)))
    assert [[p.doc for p in w] for w in packer.given_out()] == [[9]]
    packer.add(packing.Piece(5, 5, 0, 5, np.arange(5)))  # 8's gap of 2 is filled, the rest of 3 goes to 6
    assert [[(p.doc, p.length) for p in w] for w in packer.given_out()] == [[(8, 8), (5, 2)]]
    assert [[(p.doc, p.start, p.length) for p in w] for w in packer.leftovers()] == [[(6, 0, 6), (5, 2, 3)]]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    library = Tokenizer.from_file(PATH)
    out = QUERIES["op11_bounded_space_packing"](spark, SF).collect()
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in out if r.doc_id == d.doc_id), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    used = {}
    for r in out:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(1024 - n for n in used.values() if n & (n - 1)) < 0.01 * sum(used.values())


def test_a_very_long_text(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(["The", "ing", "é", "日本", "it's", "x|y"]) + rng.choice(["", ".", ",", "\n"]) for _ in range(300_000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "z" * 100_000)], "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    want = {1: [*library.encode(text, add_special_tokens=False).ids, 0], 2: [*library.encode("short", add_special_tokens=False).ids, 0], 3: [*library.encode("z" * 100_000, add_special_tokens=False).ids, 0]}
    assert held(packing.pack(df, PATH), want, 1024) < 0.001 * sum(map(len, want.values()))

import random
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cladewise.llm import alignment, segments
from cladewise.llm.queries import QUERIES

PATH_A, PATH_B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "  ", "\n", "a ", "a \n", "\n\na", " lead", "It's <|endoftext|> x <s></s><unk><0x41>", "a▁b c", "▁", "x;\r\n y", "a\tb \t c", "tab\t end", "日本語 テキスト。\n🙂 ok", "ﬁ ① é é", "n" * 3000, "a\x00b \x85 c\x1cd"]
    parts = ["The", "ing", " ", " ", "\n", "\t", "\r", ";", ");", "é", "7", "'s", "<s>", "<|endoftext|>", "!!", ".", "　", "\xa0", "’", "日", "🙂", "\x85", "᠎", "​", "*/", "{"]
    for _ in range(400):
        out.append("".join(rng.choice(parts) for _ in range(rng.randrange(40))))
    return out


class Whole:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        self.a.encode_special_tokens = True
        values = alignment.byte_values()
        self.bytes_a = {i: bytes(values[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in values for c in t)}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]

    def tokens(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a, b = ([(i, held[i]) for i in ids] for ids, held in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.bytes_a), (self.b.encode(text), self.bytes_b)))
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def brute(whole, rows):
    """The contract by plain loops."""
    spans = []
    for _, text in rows:
        sides = []
        for tokens in whole.tokens(text):
            at, own = 0, []
            for i, x in tokens:
                own.append((i, at, at + len(x)))
                at += len(x)
            sides.append(own)
        spans.append(sides)
    links = []
    for a, b in spans:
        own, j = [], 0
        for i, x, y in a:
            while j < len(b) and b[j][2] <= x:
                j += 1
            k = j
            while k < len(b) and b[k][1] < y:
                own.append((i, b[k][0]))
                k += 1
        links.append(own)
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc, _), (a, b), own in zip(rows, spans, links, strict=True):
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        groups, before = [], 0
        for e in ends:
            groups.append(f"{','.join(str(i) for i, _, y in a if before < y <= e)}|{','.join(str(i) for i, _, y in b if before < y <= e)}")
            before = e
        out.append((doc, len(a), len(b), len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), ";".join(groups)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def whole():
    return Whole()


def test_segments_are_encoded_as_whole_texts(whole):
    a, b = alignment.side_a(PATH_A), alignment.side_b(PATH_B)
    assert b.apart
    for t in texts():
        kept = alignment.unchanged(pa.array([t], pa.string()), b)
        parts = segments.split(kept, lead=" ")[0].to_pylist()
        want_a, want_b = whole.tokens(t)
        assert [i for p in a.encode(parts) for i in p] == [i for i, _ in want_a]
        assert [i for p in b.encode(parts) for i in p] == [i for i, _ in want_b]


def test_every_character_keeps_its_bytes():
    a, b = alignment.side_a(PATH_A), alignment.side_b(PATH_B)
    every = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 500):
        text = "x".join(every[at : at + 500])
        held = alignment.unchanged(pa.array([text], pa.string()), b)
        if "▁" in text:
            assert held.null_count == 1
        else:
            assert held.null_count == 0 and alignment.aligned([" " + text], a, b)[1][3, 0] > 0


@pytest.mark.parametrize(("block", "broadcast", "chunk"), [(1 << 20, 10**6, 10**5), (300, 10**6, 1), (300, 0, 10**5)])
def test_against_plain_loops(spark, whole, monkeypatch, block, broadcast, chunk):
    monkeypatch.setattr(alignment, "BROADCAST", broadcast)
    rows = [*enumerate(texts()), (None, "no id"), (3, "same same"), (3, "same same")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, groups int").repartition(3)
    got = sorted(map(tuple, alignment.align(df, PATH_A, PATH_B, block=block, chunk=chunk).collect()), key=str)
    assert got == brute(whole, rows)


def test_pieces_that_reach_over_blanks(spark, whole, monkeypatch):
    monkeypatch.setattr(alignment.side_b(PATH_B), "apart", False)
    parts = segments.split(pa.array(["a b", None, "", "c\nd "]), lead=" ", whole=True)
    assert parts[0].to_pylist() == [" a b", " c\nd "] and parts[1].tolist() == [1, 0, 0, 1]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, PATH_A, PATH_B).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(none, PATH_A, PATH_B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, whole):
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_cross_tokenizer_alignment"](spark, SF).collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(whole, rows)]
    assert sorted(got, key=str) == sorted(want, key=str)

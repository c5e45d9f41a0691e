import duckdb
import pandas as pd

from cladewise.llm import chat


def brute(rows, segment):
    rows = [(c, t, (r or "unknown").replace("|>", "| >"), (x or "").replace("<|", "< |")) for c, t, r, x in rows]
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for speaker in {r[2] for r in own} - {"system"}:
            at = 0
            for _, t, role, text in own:
                head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user {role}|>\n"
                k = (c, speaker, None if t is None else t // segment)
                e = out.setdefault(k, [at, 0, "", []])
                e[1] += 1
                e[2] += head + text + "<|end|>\n"
                if role == speaker:
                    e[3].append((at + len(head), at + len(head) + len(text) + 7))
                at += len(head) + len(text) + 8
    return out


ROWS = [
    (1, 0, "system", "be"), (1, 1, "ann", "hé <|end|>"), (1, 2, "bob", ""), (1, 2, "bob", ""), (1, 3, None, None), (1, 9, "ann", "x" * 50), (1, None, "bob", "first"),
    (2, 0, "system", "alone"), (None, 5, "a|>b", "null conv"), (None, 5, "c", "🙂"), (3, 0, "", "only"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "n") for r in ROWS], "conv_id long, turn long, role string, text string, speaker string").repartition(3)
    got = {(r.conv, r.speaker, r.segment): [r.offset, r.n_turns, r.text, [tuple(m) for m in r.masks]] for r in chat.perspectives(df, segment=4).collect()}
    assert got == brute(ROWS, 4)
    assert chat.perspectives(df.limit(0)).count() == 0


def test_masks_are_what_the_assistant_wrote(spark):
    rows = [(1, i, "ab"[i % 2], f"turn {i}") for i in range(200)]
    views = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for speaker in "ab":
        own = sorted((r for r in views if r.speaker == speaker), key=lambda r: r.segment)
        whole = "".join(r.text for r in own)
        assert [r.offset for r in own] == [sum(len(x.text) for x in own[:k]) for k in range(len(own))]
        assert [whole[m.start : m.end] for r in own for m in r.masks] == [f"turn {i}<|end|>" for i in range(200) if "ab"[i % 2] == speaker]


def test_sql(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = chat.flat(chat.perspectives(df)).withColumnRenamed("conv", "conv_id").collect()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat.ORACLE).fetchall()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_no_python(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = chat.perspectives(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

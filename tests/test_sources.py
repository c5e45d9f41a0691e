import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cladewise.sources import bam as M
from cladewise.sources import readers as R
from cladewise.sources import sinks as S


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_manifest_and_names(spark, tmp_path):
    df = R.sample_manifest(spark, put(tmp_path, "m.csv", "a/x.bam,r.fa,one\na/y.bam,r.fa\n"))
    assert rows(df, "bam") == [("a/x.bam", "r.fa", "one"), ("a/y.bam", "r.fa", "y")]
    assert R.manifest_faults(df).count() == 0
    bad = spark.createDataFrame([("x", "r", "a b"), ("x", "r", "c"), (None, "r", "c")], "bam string, ref string, alias string")
    assert {r.fault for r in R.manifest_faults(bad).collect()} == {"alias twice", "file twice", "white space", "missing column"}
    assert rows(R.names(spark, put(tmp_path, "n.txt", "b\n\n a \n")), "name") == [("a",), ("b",)]
    with pytest.raises(Exception, match="more than once in the list of names: b"):
        R.names(spark, put(tmp_path, "twice.txt", "b\n\n a \nb\n")).collect()
    with pytest.raises(ValueError, match="no names"):
        R.names(spark, put(tmp_path, "none.txt", "\n \n"))


def test_a_tip_with_many_reads_is_split_once(spark, tmp_path):
    df = R.read_names(spark, put(tmp_path, "r.csv", "t1," + ",".join(f"q{i}" for i in range(5000)) + "\nt2,q5000\n")).select("tip", "name")
    # Nothing above the rows of names splits a line again, once for each name.
    above, _, below = df._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert "split(" not in above and "split(" in below
    assert sorted(rows(df, "name")) == sorted([("t1", f"q{i}") for i in range(5000)] + [("t2", "q5000")])


def test_fasta_round_trip(spark, tmp_path):
    df = R.fasta(spark, put(tmp_path, "s.fasta", ">one x\nAC\ngt\n>two\nA-GT\n"))
    assert rows(df.select("seq_id", "seq"), "seq_id") == [("one", "ACGT"), ("two", "A-GT")]
    assert R.unequal_lengths(df).count() == 0
    assert rows(R.alignment_columns(df).where("base = '-'").select("seq_id", "pos"), "pos") == [("two", 2)]
    S.write_fasta(df.select("seq_id", "seq"), str(tmp_path / "out"))
    assert rows(R.fasta(spark, str(tmp_path / "out" / "*.txt")).select("seq_id", "seq"), "seq_id") == [("one", "ACGT"), ("two", "A-GT")]


def test_sam(spark, tmp_path):
    text = "@SQ\tSN:r\tLN:50\nq1\t0\tr\t5\t60\t2S3M1I2M1D1M\t*\t0\t0\tACGTACGTA\tIIIIIIII!\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n"
    df = R.sam(spark, put(tmp_path, "x.sam", text))
    one = df.where("name = 'q1'").first()
    assert one.positions == [None, None, 5, 6, 7, None, 8, 9, 11] and one.quals == [40] * 8 + [0]
    assert df.where("name = 'q2'").first().quals is None
    assert R.sam(spark, str(tmp_path / "x.sam"), ("r", 11, 20)).count() == 1 and R.sam(spark, str(tmp_path / "x.sam"), ("r", 12, 20)).count() == 0


@pytest.mark.parametrize("text", ["((a:1,b:2.5)x:0.5,'c d':3,e);", "a;", "(a,(b,(c,d)));", "(a[&k=v,z=1]:1,b:2)r;"])
def test_newick_round_trip(text):
    assert S.to_newick([(n, p, x, label, a) for n, p, x, label, a in R.parse_newick(text)]) in (text, text.replace("k=v,z=1", "k=v,z=1"))


def test_nexus_and_tree_tables(spark, tmp_path):
    text = "#NEXUS\nbegin trees;\ntranslate\n1 A,\n2 B\n;\ntree t = [&R] (1[&INDIVIDUAL=\"h\"]:1,2:2);\nend;\n"
    df = R.trees(spark, put(tmp_path, "t_1_to_9.tree", text))
    got = rows(df.select("node", "parent", "edge_length", "is_tip", "label"), "node")
    assert got == [(0, None, None, False, None), (1, 0, 1.0, True, "A"), (2, 0, 2.0, True, "B")]
    assert df.where("label = 'A'").first().annotations == {"INDIVIDUAL": "h"}
    back = S.annotated_trees(df, nexus=True).first().text
    assert "(A[&INDIVIDUAL=h]:1,B:2)" in back and [x[3] for x in R.parse_newick(back)] == [None, "A", "B"]


@pytest.mark.parametrize("nexus", [False, True])
def test_many_trees_in_few_files(spark, tmp_path, nexus):
    """A tree in a file of several is read whole, and there are as many files as needed, not one for each tree."""
    names = ["t1", "it's", "a = b", "x.y", *(f"w {i}" for i in range(40))]
    nodes = [(f, *row) for k, f in enumerate(names) for row in ((0, None, None, None, {}), (1, 0, 0.5 + k, f"{f};(1)", {"INDIVIDUAL": "h"}), (2, 0, 2.0, "b", {}))]
    df = spark.createDataFrame(nodes, "file string, node long, parent long, edge_length double, label string, annotations map<string,string>")
    S.write_trees(df, str(tmp_path / "out"), nexus, most=5)
    files = [p.read_text() for p in (tmp_path / "out").glob("*.txt")]
    assert 9 <= len(files) < 20 and all(len(list(R.parse_trees(t))) <= 5 for t in files)
    back = R.trees(spark, str(tmp_path / "out"))
    assert back.select("path", "tree").distinct().count() == len(names) and back.where("node = 0").count() == len(names)
    got = sorted((r.label, r.edge_length, r.is_tip, r.annotations) for r in back.where("node = 1").collect())
    assert got == sorted((f"{f};(1)", 0.5 + k, True, {"INDIVIDUAL": "h"}) for k, f in enumerate(names))


def test_every_tree_of_a_nexus_file(spark, tmp_path):
    text = "#NEXUS\nbegin trees;\ntranslate\n1 A,\n2 B\n;\ntree s = [&R] (1:1,2:2);\nutree * t = (2:3,1:4);\nend;\n"
    df = R.trees(spark, put(tmp_path, "s.tree", text))
    assert rows(df.where("is_tip").select("tree", "label", "edge_length"), "tree", "label") == [(0, "A", 1.0), (0, "B", 2.0), (1, "A", 4.0), (1, "B", 3.0)]


def test_small_tables(spark, tmp_path):
    assert rows(R.duplicates(spark, put(tmp_path, "d.csv", "a,b\n\nc , d,e\n")).groupBy("set_id").agg(F.count("*").alias("n")).select("n"), "n") == [(2,), (3,)]
    assert rows(R.tree_constants(spark, put(tmp_path, "c.csv", "t1,2.5\nt1,9\nt2,x\n")), "file") == [("t1", 2.5), ("t2", 1.0)]
    assert rows(R.normalisation(spark, put(tmp_path, "p.csv", "POSITION,X\n1,0.5\n2,0.7\n")), "pos") == [(1, 0.5), (2, 0.7)]
    assert rows(R.blacklist_report(spark, put(tmp_path, "b.csv", "tree.id,tip,kept,status\nt,a,TRUE,included\nt,b,FALSE,bl\n")).select("tip", "kept"), "tip") == [("a", True), ("b", False)]
    assert rows(R.read_names(spark, put(tmp_path, "r.csv", "t1,q1,q2\nt2,q3\n")).select("tip", "name"), "name") == [("t1", "q1"), ("t1", "q2"), ("t2", "q3")]
    assert rows(R.recombination(spark, put(tmp_path, "z.csv", "Bam file,Recombination metric\na/x.bam,0.5\n")), "sample") == [("x.bam", 0.5)]
    assert rows(R.window_exploration(spark, put(tmp_path, "w.csv", "Width 100\n1,5,6\n101,7,8\n\nWidth 200\n1,9,9\n")), "width", "w_start", "sample") == [(100, 1, 0, 5), (100, 1, 1, 6), (100, 101, 0, 7), (100, 101, 1, 8), (200, 1, 0, 9), (200, 1, 1, 9)]
    a = spark.createDataFrame([("t_1_to_9.tree",), ("t_5_to_9.tree",)], "name string")
    assert rows(R.matched(a, spark.createDataFrame([("d_1_to_9.csv",)], "name string")), "tree") == [("t_1_to_9.tree", "d_1_to_9.csv"), ("t_5_to_9.tree", None)]
    both, odd = R.half_matched(a.withColumn("x", F.lit(1)), a.limit(1), "name")
    assert both.count() == 1 and odd.count() == 1


def member(data):
    """A gzip member with its length in an extra field, from the published layout."""
    body = zlib.compress(data, wbits=-15)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_bytes(refs, lines, long=False):
    """A BAM file of SAM lines, in members of 200 bytes so that records cross them, written from the published layout."""
    out = b"BAM\1" + struct.pack("<i", 3) + b"@CO" + struct.pack("<i", len(refs))
    for r in refs:
        out += struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 1000)
    for line in lines:
        name, flag, ref, pos, mapq, cigar, _, _, _, seq, qual = line.split("\t")
        seq = "" if seq == "*" else seq
        ops, n = [], ""
        for c in "" if cigar == "*" else cigar:
            if c.isdigit():
                n += c
            else:
                ops.append(int(n) << 4 | "MIDNSHP=X".index(c))
                n = ""
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", refs.index(ref) if ref != "*" else -1, int(pos) - 1, len(name) + 1, int(mapq), 0, len(ops), int(flag), len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        body += b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        body += b"NMC\5"  # a tag that is not read
        if long and len(ops) > 2:  # as a CIGAR of too many operations is kept: a stand-in, and the whole in a tag after others
            at = 32 + len(name) + 1
            stand_in = struct.pack("<2I", len(seq) << 4 | 4, 9 << 4 | 3)
            body = body[:12] + struct.pack("<H", 2) + body[14:at] + stand_in + body[at + 4 * len(ops) :]
            body += b"RGZCGB\0" + b"ZZBs" + struct.pack("<i2h", 2, 1, 2) + b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        out += struct.pack("<i", len(body)) + body
    return b"".join(member(out[i : i + 200]) for i in range(0, len(out), 200)) + member(b"")


def sam_lines(k, n):
    draw, lines = random.Random(k), []
    for i in range(n):
        parts = [(draw.randint(1, 9), draw.choice("MIDS=XNHP")) for _ in range(draw.randint(1, 6))]
        m = sum(x for x, op in parts if op in "MIS=X")
        seq = "".join(draw.choice("ACGTN") for _ in range(m))
        qual = "*" if i % 7 == 0 or not m else "".join(chr(33 + draw.randint(0, 60)) for _ in range(m))
        lines.append(f"q{i}\t{draw.choice((0, 16, 99))}\t{draw.choice(('r', 'other'))}\t{draw.randint(1, 60)}\t{i % 61}\t{''.join(f'{x}{op}' for x, op in parts)}\t*\t0\t0\t{seq or '*'}\t{qual}")
    return [*lines, "u\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*", "e\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]


def test_bam_reads_as_sam_does(spark, tmp_path):
    for name, k, n in (("one", 1, 150), ("two", 2, 40), ("empty", 3, 0)):
        lines = sam_lines(k, n) if n else []
        put(tmp_path, f"{name}.sam", "".join(x + "\n" for x in ["@SQ\tSN:r\tLN:1000", *lines]))
        (tmp_path / f"{name}.bam").write_bytes(bam_bytes(["other", "r"], lines, long=name == "two"))
    for region in (None, ("r", 20, 30)):
        sam = R.sam(spark, str(tmp_path / "*.sam"), region).withColumn("sample", F.regexp_replace("sample", "sam$", "bam"))
        bam = R.bam(spark, str(tmp_path / "*.bam"), region)
        assert bam.columns == sam.columns
        assert rows(bam, "sample", "name") == rows(sam, "sample", "name")
        assert region or bam.count() == 194


def test_bam_that_is_broken_is_an_error(spark, tmp_path):
    whole = b"".join(M.inflated(x) for x in blocks_of(bam_bytes(["other", "r"], sam_lines(1, 3))))
    good = member(whole)
    wrong = good[:-8] + bytes([good[-8] ^ 1]) + good[-7:]
    for name, content, said in (("cut", member(whole[:-9]), "ends within a record"), ("none", member(b"SAM" + whole[3:]), "not a BAM file"), ("sum", wrong, "checksum"), ("half", good[:-3], "isn't whole"), ("text", b"no blocks", "no whole block")):
        (tmp_path / f"{name}.bam").write_bytes(content)
        with pytest.raises(Exception, match=said):
            R.bam(spark, str(tmp_path / f"{name}.bam")).collect()


def blocks_of(raw):
    out = []
    while raw:
        n = M.block_size(raw)
        out, raw = [*out, raw[:n]], raw[n:]
    return out


@pytest.fixture
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "1500"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_one_bam_file_in_many_tasks(spark, tmp_path, small_splits):
    lines = sam_lines(5, 400)
    # One record longer than several splits.
    draw = random.Random(2)
    lines.insert(200, "long\t0\tr\t7\t9\t9000M\t*\t0\t0\t" + "".join(draw.choice("ACGT") for _ in range(9000)) + "\t" + "".join(chr(33 + draw.randint(0, 60)) for _ in range(9000)))
    raw = bam_bytes(["other", "r"], lines)
    (tmp_path / "x.bam").write_bytes(raw)
    put(tmp_path, "x.sam", "".join(x + "\n" for x in lines))
    for region in (None, ("r", 20, 30)):
        bam = R.bam(spark, str(tmp_path / "x.bam"), region)
        sam = R.sam(spark, str(tmp_path / "x.sam"), region).withColumn("sample", F.lit("x.bam"))
        assert rows(bam, "name") == rows(sam, "name")
    # Several tasks have records of their own.
    found = M.records(spark, str(tmp_path / "x.bam"))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_first_bytes_of_a_block_within_a_block(spark, tmp_path):
    rows_ = b"".join(M.encoded(f"q{i}", 0, 0, i + 1, 9, "4M", "ACGT", "IIII") + b"" for i in range(5))
    tagged = M.encoded("t", 0, 0, 9, 9, "4M", "ACGT", "IIII")
    tagged = struct.pack("<i", len(tagged) - 4 + 12) + tagged[4:] + b"XYBc" + struct.pack("<i", 4) + M.MAGIC
    data = M.header([("r", 99)]) + rows_ + tagged
    press = zlib.compressobj(0, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    block = M.MAGIC + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    assert M.MAGIC in body
    (tmp_path / "x.bam").write_bytes(block + M.EMPTY)
    assert {r.name for r in M.records(spark, str(tmp_path / "x.bam")).collect()} == {"t", *(f"q{i}" for i in range(5))}


def test_bam_is_written_and_read_again(spark, tmp_path, small_splits):
    lines = sam_lines(8, 600)
    put(tmp_path, "x.sam", "".join(x + "\n" for x in lines))
    fields = [x.split("\t") for x in lines]
    many = "".join("1M1I" for _ in range(40_000))
    reads = [(f"s{i % 3}", f[0], int(f[1]), f[2], int(f[3]), int(f[4]), f[5], f[9], f[10]) for i, f in enumerate(fields)] + [("s1", "steps", 0, "r", 3, 9, many, "A" * 80_000, "*")]
    df = spark.createDataFrame(reads, "sample string, name string, flag int, ref string, pos int, mapq int, cigar string, seq string, qual string").repartition(4)
    out = str(tmp_path / "out")
    M.write(df, out, [("other", 1000), ("r", 1000)])
    got = M.records(spark, f"{out}/*/*.bam")
    assert sorted(map(str, got.drop("file").collect())) == sorted(map(str, df.drop("sample").collect()))
    for f in (tmp_path / "out").glob("*/*.bam"):
        raw = f.read_bytes()
        data = b"".join(M.inflated(x) for x in blocks_of(raw))
        assert raw.endswith(M.EMPTY) and data.startswith(b"BAM\1")
    with pytest.raises(Exception, match="other"):
        M.write(df, str(tmp_path / "bad"), [("r", 1000)])


def test_named_reads_as_bam(spark, tmp_path):
    df = spark.createDataFrame([("s", n, 0, "r", k, 9, "2M", "AC", "II") for k, n in enumerate("abcd", 1)], "sample string, name string, flag int, ref string, pos int, mapq int, cigar string, seq string, qual string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    M.write_named(df, names("d", "a", "a"), str(tmp_path / "out"), [("r", 9)])
    assert [r.name for r in M.records(spark, str(tmp_path / "out/*/*.bam")).orderBy("pos").collect()] == ["a", "d"]
    with pytest.raises(ValueError, match="'y'"):
        M.write_named(df, names("a", "y"), str(tmp_path / "no"), [("r", 9)])
    assert not (tmp_path / "no").exists()


def test_bins():
    assert [M._bin(a, b) for a, b in ((0, 1), (16_383, 16_385), (1 << 26, (1 << 26) + 1), (0, 1 << 29), (-1, 0))] == [4681, 585, 4681 + (1 << 12), 0, 4680]



def test_bam_codec_keeps_odd_values():
    for seq, shown in (("acgtn", "ACGTN"), ("AC.x-", "ACNNN"), ("=MRSVWYHKDB", "=MRSVWYHKDB"), ("*", "*"), ("A", "A")):
        row = M.encoded("n", 0, 0, 5, 60, "*", seq, "*")
        assert M.decoded(row[4:])[6:] == (shown, "*")
    assert M.decoded(M.encoded("n", 0, 0, 5, 60, "2S3M1D1M", "ACGTAC", "!~IIII")[4:]) == ("n", 0, 0, 5, 60, "2S3M1D1M", "ACGTAC", "!~IIII")
    # A CIGAR is parsed once for all records that have it.
    held = M._operations.cache_info().hits
    assert M.encoded("m", 0, 0, 9, 60, "2S3M1D1M", "ACGTAC", "*")[4:8] == struct.pack("<i", 0) and M._operations.cache_info().hits == held + 1
    with pytest.raises(ValueError, match="printable"):
        M.encoded("n", 0, 0, 5, 60, "2M", "AC", "\tI")

"""Reads to unique sequences, duplicates, contaminants, alignments and consensuses."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import reads as R


def kept_flags(reads: DataFrame, proper_only: bool = False) -> DataFrame:
    """Mapped and primary reads by the bits of `flag`; proper pairs only, if asked for. Missing qualities are 106."""
    flag = F.col("flag")
    rows = reads.where((flag.bitwiseAND(4) == 0) & (flag.bitwiseAND(2048) == 0))
    if proper_only:
        rows = rows.where((flag.bitwiseAND(1) == 0) | (flag.bitwiseAND(2) != 0))
    return rows.withColumn("quals", F.coalesce("quals", F.transform("positions", lambda _: F.lit(106))))


def processed(reads: DataFrame, left: Column, right: Column, trim: int | None = None, low: int | None = None, recover: bool = False, keep_overhangs: bool = False, exact: bool = False) -> DataFrame:
    """recover, span, trim, span again, quality, cut: reads (seq, positions, quals) that stay, as they stay.

    The steps are one expression over a read's arrays, in which each step's result is computed once.
    """

    def sliced(x: Column, at: Column) -> Column:
        """The bases from at.a on, at.n of them; null if there are none."""
        part = lambda r: F.struct(F.substr(x["seq"], r["a"], r["n"]).alias("seq"), F.slice(x["positions"], r["a"], r["n"]).alias("positions"), F.slice(x["quals"], r["a"], r["n"]).alias("quals"))
        return R.let(at, lambda r: F.when(r["n"] > 0, part(r)))

    def ended(x: Column) -> Column:
        good = x.isNotNull() if low is None else ~R.low_quality(x["quals"], low)
        return F.when(good, x if keep_overhangs or exact else sliced(x, R.cut_to_window(x["positions"], left, right)))

    def trimmed(x: Column) -> Column:
        if trim is None:
            return ended(x)
        return R.let(sliced(x, R.trim_range(x["quals"], trim)), lambda y: F.when(R.spans_window(y["positions"], left, right, exact), ended(y)))

    first = F.struct(F.col("seq").alias("seq"), (R.recovered_ends(F.col("positions")) if recover else F.col("positions")).alias("positions"), F.col("quals").alias("quals"))
    whole = R.let(first, lambda x: F.when(R.spans_window(x["positions"], left, right, exact), trimmed(x)))
    others = [c for c in reads.columns if c not in ("seq", "positions", "quals")]
    kept = F.explode(F.filter(F.array(whole), lambda x: x.isNotNull()))
    return reads.select(*others, kept.alias("_kept")).select(*others, "_kept.*").select(*reads.columns)


def merged_mates(reads: DataFrame) -> DataFrame:
    """Mates (sample, name, positions, seq, quals) that overlap and agree on their places become one read.

    The left mate starts first (ties: the first by sequence). In the overlap the base of higher quality stays,
    the left one's on a tie. Mates without an overlap or with other places in it are dropped; reads without a
    mate stay. A template has two reads at most; a third read of a name is an error of the input and stops the run.
    """
    order = Window.partitionBy("sample", "name").orderBy(R.first_place(F.col("positions")), "seq")
    rows = reads.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("sample", "name"))})
    single = rows.where("_n = 1").select("sample", "name", "seq", "positions", "quals")
    third = F.raise_error(F.concat(F.lit("more than two reads of the name "), "name", F.lit(" in the sample "), "sample"))
    two = rows.where(F.when(F.col("_n") > 2, third).otherwise(F.col("_n") == 2))
    a = two.where("_k = 1").select("sample", "name", *[F.col(c).alias(f"{c}_a") for c in ("seq", "positions", "quals")])
    b = two.where("_k = 2").select("sample", "name", *[F.col(c).alias(f"{c}_b") for c in ("seq", "positions", "quals")])
    rows = a.join(b, ["sample", "name"])
    at = F.array_position("positions_a", R.first_place(F.col("positions_b"))).cast("int")  # where the right mate begins
    skip = F.array_position(F.transform("positions_b", lambda p: p.isNotNull()), True).cast("int") - 1
    rows = rows.withColumns({"_at": at, "_skip": skip}).where("_at > 0")
    shared = F.least(F.size("positions_a") - F.col("_at") + 1, F.size("positions_b") - F.col("_skip"))
    rows = rows.withColumn("_shared", shared)
    mine = F.slice("positions_a", F.col("_at"), F.col("_shared"))
    other = F.slice("positions_b", F.col("_skip") + 1, F.col("_shared"))
    agree = F.forall(F.arrays_zip(mine.alias("m"), other.alias("o")), lambda x: x["m"].eqNullSafe(x["o"]))
    rows = rows.where(agree)
    zipped = lambda side: F.arrays_zip(F.split(F.col(f"seq_{side}"), "").alias("s"), F.col(f"positions_{side}").alias("p"), F.col(f"quals_{side}").alias("q"))
    left, right = zipped("a"), zipped("b")
    head = F.slice(left, F.lit(1), F.col("_at") - 1)
    best = F.zip_with(F.slice(left, F.col("_at"), F.col("_shared")), F.slice(right, F.col("_skip") + 1, F.col("_shared")), lambda x, y: F.when(y["q"] > x["q"], y).otherwise(x))
    tail_b = F.slice(right, F.col("_skip") + 1 + F.col("_shared"), F.size("positions_b"))
    tail_a = F.slice(left, F.col("_at") + F.col("_shared"), F.size("positions_a"))
    whole = F.concat(head, best, F.when(F.size(tail_b) > 0, tail_b).otherwise(tail_a))
    rows = rows.withColumn("_w", whole).select("sample", "name", F.array_join(F.transform("_w", lambda x: x["s"]), "").alias("seq"), F.transform("_w", lambda x: x["p"]).alias("positions"), F.transform("_w", lambda x: x["q"]).alias("quals"))
    return single.unionByName(rows)


def unique_counts(reads: DataFrame, *keys: str, names: bool = False) -> DataFrame:
    """Reads by sequence: n, and their names if asked for."""
    return reads.groupBy(*keys, "seq").agg(F.count("*").alias("n"), *([F.sort_array(F.collect_list("name")).alias("names")] if names else []))


def ranked(tips: DataFrame, *keys: str, min_count: int = 1) -> DataFrame:
    """Rank by count (ties: by sequence) of those with enough, and the label."""
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "seq")
    rows = tips.where(F.col("n") >= min_count).withColumn("rank", F.row_number().over(order))
    return rows.withColumn("label", R.tip_label(F.col(keys[-1]), F.col("rank"), F.col("n")))


def cross_sample_duplicates(tips: DataFrame, window: str = "window_id", sample: str = "sample") -> DataFrame:
    """Pairs of samples with one sequence in a window: sample_1 < sample_2, n_1, n_2, seq."""
    a = tips.select(window, "seq", F.col(sample).alias("sample_1"), F.col("n").alias("n_1"))
    b = tips.select(window, "seq", F.col(sample).alias("sample_2"), F.col("n").alias("n_2"))
    return a.join(b, [window, "seq"]).where("sample_1 < sample_2")


def sequence_classes(tips: DataFrame, window: str = "window_id", sample: str = "sample") -> DataFrame:
    """One row for each sequence of a window that several samples have: window, seq, samples, top (n and sample of the commonest), second (the largest n of another sample)."""
    best = F.max(F.struct("n", sample)).over(Window.partitionBy(window, "seq"))
    rows = tips.select(window, "seq", sample, "n", best.alias("top"))
    return rows.groupBy(window, "seq", "top").agg(F.count("*").alias("samples"), F.max(F.when(F.col(sample) != F.col(f"top.{sample}"), F.col("n"))).alias("second")).where("second is not null")


def contaminants(tips: DataFrame, ratio: float, window: str = "window_id", sample: str = "sample") -> DataFrame:
    """Samples whose count of a sequence is so much rarer than another sample's: window, sample, seq. A sequence's largest count decides for all but its own sample, and the second largest for that one, so no pairs are made."""
    by_class = Window.partitionBy(window, "seq")
    top = F.max(F.struct("n", sample)).over(by_class)
    rows = tips.select(window, sample, "seq", "n").withColumn("_top", top)
    second = F.max(F.when(F.col(sample) != F.col(f"_top.{sample}"), F.col("n"))).over(by_class)
    rows = rows.withColumn("_other", F.when(F.col(sample) == F.col(f"_top.{sample}"), second).otherwise(F.col("_top.n")))
    return rows.where(F.col("_other") / F.col("n") >= ratio).select(window, sample, "seq")


def duplicate_sets(tips: DataFrame, window: str = "window_id") -> DataFrame:
    """Labels that share a sequence in a window: window, labels, n. A sample stands once in a set."""
    return tips.groupBy(window, "seq").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.count("*").alias("n"), F.countDistinct("sample").alias("samples")).where("n > 1").select(window, "labels", "n", (F.col("n") != F.col("samples")).alias("repeated_sample"))


def without(reads: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Reads that are not among the known ones by keys (contaminants, names of earlier windows, blacklists)."""
    return reads.join(known.select(*keys).distinct(), list(keys), "left_anti")


def not_used_before(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads (window_id, sample, name) whose name no overlapping previous window has used: greedy over windows, as a scan by window.

    A name is used in a window if it is kept there, so keeping alternates: within a run of neighbouring overlapping
    windows every second one keeps the name. Rows of one name in one window share its lot.
    """
    prev = Window.orderBy("window_id")
    linked = windows.withColumn("linked", F.coalesce(F.col("w_start") <= F.lag("w_end").over(prev), F.lit(False))).select("window_id", "linked")
    by_name = Window.partitionBy("sample", "name").orderBy("window_id")
    rows = spans.select("window_id", "sample", "name").distinct().join(linked, "window_id").withColumn("new", F.when((F.col("window_id") - F.lag("window_id").over(by_name) == 1) & F.col("linked"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(by_name)).withColumn("k", F.row_number().over(Window.partitionBy("sample", "name", "run").orderBy("window_id")))
    return spans.join(rows.where("k % 2 = 1"), ["window_id", "sample", "name"], "left_semi")


def unique_by_window(tips: DataFrame, samples: list[str], *keys: str) -> DataFrame:
    """Unique sequences of each sample, one column for each."""
    return tips.groupBy(*keys).pivot("sample", samples).agg(F.count(F.lit(1))).na.fill(0, samples)


def width_percentiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """Percentiles (linear interpolation) of n by width."""
    return counts.groupBy("width").agg(F.percentile("n", F.array(*map(F.lit, shares))).alias("p")).select("width", *[F.col("p")[i].alias(f"p{int(100 * x)}") for i, x in enumerate(shares)])


def expected_spanning(lengths: DataFrame, reference: int, normalise: bool = False) -> DataFrame:
    """For each width the expected number of reads (length, n) that span it, over all starts of the reference."""
    rows = lengths.select("n", "length", F.explode(F.sequence(F.lit(1), F.col("length").cast("int"))).alias("width"))
    out = rows.groupBy("width").agg(F.sum(F.col("n") * (F.col("length") + 1 - F.col("width")) / (reference + 1 - F.col("width"))).alias("expected"))
    if normalise:
        out = out.crossJoin(F.broadcast(out.where("width = 1").select(F.col("expected").alias("_one")))).withColumn("expected", F.col("expected") / F.col("_one")).drop("_one")  # one row
    return out


def insert_sizes(reads: DataFrame) -> DataFrame:
    """Counts of sizes (kind, size, n): the union of overlapping mates, or each mate's length, or an orphan's."""
    rows = reads.groupBy("sample", "name").agg(F.count("*").alias("k"), F.min("first_pos").alias("lo"), F.max("last_pos").alias("hi"), F.max("first_pos").alias("lo2"), F.min("last_pos").alias("hi2"), F.collect_list(F.col("last_pos") - F.col("first_pos") + 1).alias("each"))
    paired = (F.col("k") == 2) & (F.col("lo2") <= F.col("hi2"))
    sizes = rows.select(F.when(F.col("k") == 1, "orphan").when(paired, "overlapping").otherwise("apart").alias("kind"), F.explode(F.when(paired, F.array(F.col("hi") - F.col("lo") + 1)).otherwise(F.col("each"))).alias("size"))
    return sizes.groupBy("kind", "size").agg(F.count("*").alias("n"))


# -- alignments (window_id, seq_id, pos, base, n) ----------------------------------------------------------


def reassembled(bases: DataFrame, *keys: str) -> DataFrame:
    return bases.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))


def found_sequences(seqs: DataFrame, names: list[str], prefix: bool = False, inverted: bool = False, window: tuple[int, int] | None = None, gap_strip: bool = False, skip_blanks: bool = False) -> DataFrame:
    """Sequences (name, seq) of the names, or whose name begins with one, or all others; cut to a window, without gaps (- and ?), without blank ones.

    Repeated names among those found, names without a sequence (unless they are beginnings), nothing found, and
    a sequence that ends within the window are errors.
    """
    if prefix:
        hit = F.lit(False)
        for x in names:
            hit = hit | F.startswith(F.col("name"), F.lit(x))
    else:
        hit = F.col("name").isin(names)
    found = seqs.where(~hit if inverted else hit)
    if found.isEmpty():
        raise ValueError("no sequence is found")
    if not found.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("a name has several sequences")
    if not prefix and (missing := set(names) - {r.name for r in seqs.where(F.col("name").isin(names)).select("name").distinct().collect()}):
        raise ValueError(f"no sequence has the names {sorted(missing)}")
    if window is not None:
        if not found.where(F.length("seq") < window[1]).isEmpty():
            raise ValueError("a sequence ends within the window")
        found = found.withColumn("seq", F.substring("seq", window[0], window[1] - window[0] + 1))
    bare = F.regexp_replace("seq", "[-?]", "")
    if skip_blanks:
        found = found.where(bare != "")
    return found.withColumn("seq", bare) if gap_strip else found


def without_gap_columns(bases: DataFrame, window: str = "window_id") -> DataFrame:
    """Columns in which any sequence has a base."""
    return bases.join(bases.where("base <> '-'").select(window, "pos").distinct(), [window, "pos"], "left_semi")


def excised(bases: DataFrame, places: list[int], window: str = "window_id") -> DataFrame:
    """Sequences without the given columns, equal ones counted together: window, seq, n."""
    rows = reassembled(bases.where(~F.col("pos").isin(places)), window, "seq_id", "n")
    return rows.groupBy(window, "seq").agg(F.sum("n").alias("n"))


def consensus(bases: DataFrame, *keys: str) -> DataFrame:
    """The base (or gap) with the largest count in each column; ties by the lesser base. total: the sum of counts."""
    by = bases.groupBy(*keys, "pos", "base").agg(F.sum("n").alias("n"))
    best = by.groupBy(*keys, "pos").agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("base"), F.sum("n").alias("total"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"), F.max("total").alias("total"))


def alignment_summary(bases: DataFrame, threshold: float, window: str = "window_id") -> DataFrame:
    """Columns, the sum of their shares of bases, and the columns with the share or more."""
    share = bases.groupBy(window, "pos").agg(F.avg((F.col("base") != "-").cast("double")).alias("share"))
    return share.groupBy(window).agg(F.count("*").alias("columns"), F.sum("share").alias("bases"), F.count_if(F.col("share") >= threshold).alias("dense"))


# -- order-dependent merges, by (window, sample) -----------------------------------------------------------


def _codes(seqs: list[str]) -> np.ndarray:
    """One row of characters for each sequence, padded with 0: two rows differ in as many places as their lengths and common places do."""
    wide = max(map(len, seqs), default=0)
    return np.array(seqs, dtype=f"U{max(1, wide)}").view(np.uint32).reshape(len(seqs), -1) if seqs else np.zeros((0, 1), np.uint32)


def pieces(tips: DataFrame, threshold: int, window: str = "window_id", sample: str = "sample") -> DataFrame:
    """window, sample, wide (the longest sequence), part, piece, seq: each sequence cut at the same threshold + 1 places of its group. Two within the threshold have a piece in common."""
    n = threshold + 1
    rows = tips.select(window, sample, "seq", F.max(F.length("seq")).over(Window.partitionBy(window, sample)).alias("wide"))
    edge = lambda i: F.floor(F.lit(i) * F.col("wide") / n).cast("int")
    cut = F.array(*[F.substr("seq", edge(i) + 1, edge(i + 1) - edge(i)) for i in range(n)])
    return rows.select(window, sample, "wide", F.posexplode(cut).alias("part", "piece"), "seq")


def similar_pairs(tips: DataFrame, threshold: int, window: str = "window_id", sample: str = "sample") -> DataFrame:
    """Pairs of a group's sequences within the threshold, once each: window, sample, a, b. Only sequences with a piece in common are compared."""
    rows = pieces(tips, threshold, window, sample).repartition(window, sample, "part", "piece")
    # A piece that one sequence has alone leaves before any Python.
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(window, sample, "part", "piece"))).where("_n > 1")
    rows = rows.sortWithinPartitions(window, sample, "part", "piece", "seq")
    rows = rows.select(F.struct(window, sample, "part", "piece").alias("group"), window, sample, "wide", "part", "seq")

    def found(held: list[tuple]) -> pa.RecordBatch:
        (_, w, s, wide, part, _), seqs = held[0], [r[5] for r in held]
        text, edges, one, two = _codes(seqs), np.arange(threshold + 1) * max(1, wide) // (threshold + 1), [], []
        text = np.pad(text, ((0, 0), (0, max(1, wide) - text.shape[1])))
        for i in range(len(seqs) - 1):
            differ = text[i + 1 :] != text[i]
            near = differ.sum(axis=1) <= threshold
            # A pair that has an earlier piece in common is found there.
            for e in range(part):
                near &= differ[:, edges[e] : edges[e + 1]].any(axis=1)
            for j in np.flatnonzero(near).tolist():
                one.append(seqs[i])
                two.append(seqs[i + 1 + j])
        n = len(one)
        return pa.RecordBatch.from_arrays([pa.array([w] * n, kinds[0]), pa.array([s] * n, kinds[1]), pa.array(one, pa.string()), pa.array(two, pa.string())], names=[window, sample, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    if len(held) > 1:
                        yield found(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield found(held)

    fields = [tips.schema[window], tips.schema[sample]]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    return rows.mapInArrow(run, StructType(fields).add("a", "string").add("b", "string"))


def absorb_common_first(counts: list[tuple[str, int]], near: Mapping[str, list[str]]) -> dict[str, int]:
    """Commonest first, each sequence that is left takes all rarer ones that are near; what was taken takes nothing.

    Among equal counts nothing is taken: looking goes from rare to common and ends at the first untaken equal count.
    """
    size, total = dict(counts), dict(counts)
    for seq, n in sorted(counts, key=lambda r: (r[1], r[0]), reverse=True):
        for other in near.get(seq, ()) if seq in total else ():
            if size[other] < n and other in total:
                total[seq] += total.pop(other)
    return total


def absorb_rare_first(counts: list[tuple[str, int]], near: Mapping[str, list[str]], threshold: int) -> dict[str, int]:
    """Rarest first, each sequence goes to the commonest one that is near; counts move up in chains.

    Looking goes from common to rare and ends where the lengths alone differ by more than the threshold.
    """
    rows = [r[0] for r in sorted(counts, key=lambda r: (-r[1], r[0]))]
    total, place = dict(counts), {s: i for i, s in enumerate(rows)}
    first: dict[int, int] = {}
    for i, s in enumerate(rows):
        first.setdefault(len(s), i)
    for s in reversed(rows[1:]):
        until = min((i for n, i in first.items() if abs(n - len(s)) > threshold), default=len(rows))
        best = min((place[o] for o in near.get(s, ())), default=len(rows))
        if best < min(until, place[s]):
            total[rows[best]] += total.pop(s)
    return total


def similar_merged(tips: DataFrame, threshold: int, version: str = "A", window: str = "window_id", sample: str = "sample") -> DataFrame:
    """tips (window, sample, seq, n; read twice, so cut them if they are dear) after merging. Similar pairs are found over all groups at once; the ordered pass takes one sample's sequences in one window, and its pairs."""
    fields = [tips.schema[window], tips.schema[sample]]

    def run(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(pairs["a"], pairs["b"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        counts = list(zip(rows["seq"], rows["n"].astype(int)))
        out = absorb_common_first(counts, near) if version == "A" else absorb_rare_first(counts, near, threshold)
        w, s = (rows[c].iloc[0] for c in (window, sample)) if len(rows) else (None, None)
        return pd.DataFrame({window: w, sample: s, "seq": list(out), "n": list(out.values())})

    found = similar_pairs(tips, threshold, window, sample).select(F.col(window).alias("_w"), F.col(sample).alias("_s"), "a", "b")
    held = tips.select(window, sample, "seq", F.col("n").cast("long").alias("n")).groupBy(window, sample)
    return held.cogroup(found.groupBy("_w", "_s")).applyInPandas(run, StructType(fields).add("seq", "string").add("n", "long"))


def recombination_of(array: np.ndarray, first: int, stop: int, gap_aware: bool = False) -> tuple[int, tuple[int, int, int] | None]:
    """The largest score of (parent, parent, recombinant) with the first parent from first to stop - 1 and the second after it, and the first such rows. array: the columns that differ, a row for each sequence.

    No score exceeds half of the sites at which the parents differ, so only pairs that can beat the best so far
    are tried with a third sequence.
    """
    best, found, n = 0, None, len(array)
    bases = array != "-" if array.dtype.kind == "U" else array != ord("-")
    for i in range(first, min(stop, n - 1)):
        apart = array[i + 1 :] != array[i]
        if not gap_aware:
            apart &= bases[i + 1 :] & bases[i]
        half = apart.sum(axis=1) // 2
        for x in np.flatnonzero(half > best).tolist():
            if half[x] <= best:
                continue
            j, differ = i + 1 + x, apart[x]
            rest = array[:, differ]
            sides = (rest == array[i, differ]).astype(np.int32) - (rest == array[j, differ])
            left = np.cumsum(sides, axis=1)
            right = left[:, -1:] - left[:, :-1]
            left = left[:, :-1]
            unlike, each = np.abs(left - right), np.arange(n)
            at = unlike.argmax(axis=1)
            score = np.where(unlike[each, at] > 0, np.minimum(np.abs(left), np.abs(right))[each, at], 0)
            score[[i, j]] = 0
            k = int(score.argmax())
            if score[k] > best:
                best, found = int(score[k]), (i, j, k)
    return best, found


def _differing(seqs: list[str]) -> tuple[np.ndarray, int]:
    """Characters of the columns that differ, and how many columns have a base."""
    array = _codes(seqs)
    return array[:, (array != array[0]).any(axis=0)], int((array != ord("-")).any(axis=0).sum())


def recombination_metric(seqs: list[str], gap_aware: bool = False, to_diversity: bool = False) -> tuple[float, tuple[str, str, str] | None]:
    """The largest recombination score of any (parent, parent, recombinant), and these.

    Where the parents differ, a site counts +1 if the third sequence agrees with the first parent and -1 if with
    the second. Of all breakpoints between such sites the first with the largest difference of the two sides'
    sums is taken, if the sums differ at all; the score is the lesser magnitude of the sums, over half the columns with
    a base (or the columns that differ), rounded down.
    """
    if len(seqs) < 3:
        return 0.0, None
    array, columns = _differing(seqs)
    best, found = recombination_of(array, 0, len(seqs), gap_aware)
    return best / max(1, (array.shape[1] if to_diversity else columns) // 2), None if found is None else tuple(seqs[x] for x in found)


#: First parents of a tile: each is paired with all sequences after it.
TILE = 64


def recombination(aligned: DataFrame, *keys: str, gap_aware: bool = False, tile: int = TILE) -> DataFrame:
    """Of each group of aligned sequences: metric, parent_1, parent_2, recombinant (null if 0).

    A group's sequences go to a task for each tile of first parents, so a task holds one alignment and the pairs
    of its tile; the tiles' best are compared afterwards.
    """
    # Of equal sequences two are enough: a third adds no pair and no triple of its own.
    some = aligned.groupBy(*keys, "seq").agg(F.array_repeat("seq", F.least(F.count("*"), F.lit(2)).cast("int")).alias("copies"))
    whole = some.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("copies"))).alias("seqs"))
    tiles = whole.withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.size("seqs") - 1) / tile)))).repartition(*keys, "tile")
    schema = StructType([aligned.schema[c] for c in keys]).add("score", "long").add("half", "long").add("i", "long").add("j", "long").add("parent_1", "string").add("parent_2", "string").add("recombinant", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seqs, own in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                array, columns = _differing(seqs)
                best, found = recombination_of(array, own * tile, (own + 1) * tile, gap_aware) if len(seqs) > 2 else (0, None)
                out.append((best, max(1, columns // 2), *(found[:2] if found else (None, None)), *((seqs[x] for x in found) if found else (None,) * 3)))
            made = [pa.array(c, pa.int64() if x < 4 else pa.string()) for x, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=schema.names)

    found = tiles.mapInArrow(run, schema)
    top = F.min_by(F.struct("score", "half", "parent_1", "parent_2", "recombinant"), F.struct((-F.col("score")).alias("s"), F.col("i").isNull().alias("none"), "i", "j"))
    best = found.groupBy(*keys).agg(top.alias("t"))
    return best.select(*keys, (F.col("t.score") / F.col("t.half")).alias("metric"), *[F.when(F.col("t.score") > 0, F.col(f"t.{c}")).alias(c) for c in ("parent_1", "parent_2", "recombinant")])


def kept_reads(votes: DataFrame, rule: str = "majority") -> DataFrame:
    """(sample, name, kept) over windows -> names to keep: by more than half, by all (strict) or by any (permissive)."""
    by = votes.groupBy("sample", "name")
    test = {"majority": F.avg(F.col("kept").cast("int")) > 0.5, "strict": F.bool_and("kept"), "permissive": F.bool_or("kept")}[rule]
    return by.agg(test.alias("keep")).where("keep").drop("keep")



"""Genomic windows: generation, coordinates, interval joins, and statistics by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def explicit_over(bounds: DataFrame, *keys: str) -> DataFrame:
    """Of lists of places (keys, bounds), two for each window: keys, window_id, w_start, w_end. A list has pairs of places from 1 on, each in order; another list stops the run."""
    pair = F.transform(F.sequence(F.lit(0), F.floor(F.size("bounds") / 2).cast("int") - 1), lambda i: F.struct(i.cast("long").alias("window_id"), F.get("bounds", 2 * i).cast("long").alias("w_start"), F.get("bounds", 2 * i + 1).cast("long").alias("w_end")))
    right = (F.size("bounds") >= 2) & (F.size("bounds") % 2 == 0)
    rows = bounds.select(*keys, F.explode(F.when(right, pair).otherwise(F.raise_error(F.lit("an even number of window bounds is needed")))).alias("w")).select(*keys, "w.*")
    in_order = (F.col("w_start") >= 1) & (F.col("w_start") < F.col("w_end"))
    return rows.withColumn("w_end", F.when(in_order, F.col("w_end")).otherwise(F.raise_error(F.lit("window bounds start at 1, and a window's start lies before its end")).cast("long")))


def explicit_windows(spark: SparkSession, bounds: Sequence[int]) -> DataFrame:
    """Pairs of a flat list: window_id, w_start, w_end. The list has pairs of places from 1 on, each in order."""
    if len(bounds) % 2 or not bounds:
        raise ValueError("an even number of window bounds is needed")
    if any(b < 1 for b in bounds) or any(a >= b for a, b in zip(bounds[::2], bounds[1::2])):
        raise ValueError("window bounds start at 1, and a window's start lies before its end")
    return explicit_over(spark.range(1).select(F.array(*[F.lit(b).cast("long") for b in bounds]).alias("bounds")))


def _span(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(1).select(F.lit(start).cast("long").alias("first"), F.lit(end).cast("long").alias("last"))


def sliding_over(spans: DataFrame, width: int, overlap: int, *keys: str) -> DataFrame:
    """Of stretches (keys, first, last) windows of a width that overlap: keys, window_id, w_start, w_end. A negative overlap leaves gaps; a stretch shorter than the width has none."""
    if width - overlap < 1:
        raise ValueError("windows must move on")
    step = width - overlap
    rows = spans.where(F.col("first") + width - 1 <= F.col("last")).select(*keys, "first", F.explode(F.sequence("first", F.col("last") - width + 1, F.lit(step).cast("long"))).alias("w_start"))
    return rows.select(*keys, F.floor((F.col("w_start") - F.col("first")) / step).alias("window_id"), "w_start", (F.col("w_start") + width - 1).alias("w_end"))


def sliding_windows(spark: SparkSession, width: int, overlap: int, start: int, end: int) -> DataFrame:
    """Windows of a width that overlap; a negative overlap leaves gaps. The last one ends at `end` or before."""
    if width - overlap < 1 or start + width - 1 > end:
        raise ValueError("at least one window must fit, and windows must move on")
    return sliding_over(_span(spark, start, end), width, overlap)


def exploratory_over(spans: DataFrame, widths: Sequence[int], *keys: str) -> DataFrame:
    """Of stretches (keys, first, last) for each width windows side by side: keys, width, w_start, w_end."""
    rows = spans.select("*", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])).alias("width")).where(F.col("first") + F.col("width") - 1 <= F.col("last"))
    rows = rows.select(*keys, "width", F.explode(F.sequence("first", F.col("last") - F.col("width") + 1, F.col("width"))).alias("w_start"))
    return rows.withColumn("w_end", F.col("w_start") + F.col("width") - 1)


def exploratory_windows(spark: SparkSession, widths: Sequence[int], start: int, end: int) -> DataFrame:
    """For each width windows side by side: width, w_start, w_end."""
    return exploratory_over(_span(spark, start, end), widths)


def increment_over(spans: DataFrame, width: int, increment: int | None = None, *keys: str) -> DataFrame:
    """Of stretches (keys, first, last) starts at fixed steps (a tenth of the width, 1 at least): keys, w_start, w_end. Another window ends with the stretch if the last one doesn't."""
    step, top = increment or max(1, width // 10), F.col("last") - width + 1
    starts = F.array_distinct(F.concat(F.sequence(F.col("first"), top, F.lit(step).cast("long")), F.array(top)))
    return spans.where(top >= F.col("first")).select(*keys, F.explode(starts).alias("w_start")).withColumn("w_end", F.col("w_start") + width - 1)


def increment_windows(spark: SparkSession, width: int, end: int, increment: int | None = None) -> DataFrame:
    """Starts at fixed steps (a tenth of the width, 1 at least); another window ends with the end if the last one doesn't."""
    return increment_over(_span(spark, 1, end), width, increment)


def informative_windows(columns: DataFrame, width: float, overlap: int, key: str = "aln") -> DataFrame:
    """Windows over alignments (key, pos, share: the part of sequences without a gap), each ending where the shares
    from its start on come to `width`. The next starts `overlap` before the end. A last short window is dropped.

    One alignment's columns are one array: a genome's length bounds it.
    """
    cols = columns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "share"))), lambda x: x["share"]).alias("shares"))
    empty = F.array().cast("array<struct<w_start:bigint,w_end:bigint>>")
    begin = F.struct(F.lit(1).cast("bigint").alias("start"), F.lit(0.0).alias("sum"), empty.alias("out"))
    # Each column is seen once; a new window that begins at or before the current column takes back what it overlaps.
    at = F.transform("shares", lambda s, i: F.struct(s.alias("s"), (i + 1).cast("bigint").alias("p")))

    def step(state: Column, x: Column) -> Column:
        total = state["sum"] + x["s"]
        full = total >= width - 1e-9
        start = F.greatest(x["p"] - overlap, state["start"] + 1)
        back = F.aggregate(F.when(start <= x["p"], F.slice("shares", start.cast("int"), (x["p"] - start + 1).cast("int"))).otherwise(F.array().cast("array<double>")), F.lit(0.0), lambda a, b: a + b)
        out = F.concat(state["out"], F.array(F.struct(state["start"].alias("w_start"), x["p"].alias("w_end"))))
        skipped = x["p"] < state["start"]
        return F.when(skipped, state).when(full, F.struct(start.alias("start"), back.alias("sum"), out.alias("out"))).otherwise(F.struct(state["start"].alias("start"), total.alias("sum"), state["out"].alias("out")))

    return cols.select(key, F.inline(F.aggregate(at, begin, step, lambda s: s["out"])))


def missing_windows(seen: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of windows that are missing from the regular grid of starts (least step, per data set): keys, gap_start, gap_end, n."""
    all_keys = seen.select(*keys).distinct() if keys else None
    starts = seen.select("w_start").distinct()
    order = Window.orderBy("w_start")
    step = starts.select((F.col("w_start") - F.lag("w_start").over(order)).alias("g"), "w_start").agg(F.min("g").alias("step"), F.min("w_start").alias("lo"), F.max("w_start").alias("hi"))
    grid = step.where("step is not null").select("step", F.explode(F.sequence("lo", "hi", "step")).alias("w_start"))
    grid = grid if all_keys is None else all_keys.crossJoin(F.broadcast(grid))  # the grid is one axis of window starts
    gaps = grid.join(seen.select(*keys, "w_start").distinct(), [*keys, "w_start"], "left_anti")
    by = Window.partitionBy(*keys).orderBy("w_start")
    gaps = gaps.withColumn("new", F.when(F.lag("w_start").over(by) == F.col("w_start") - F.col("step"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    return gaps.groupBy(*keys, "run").agg(F.min("w_start").alias("gap_start"), F.max("w_start").alias("gap_end"), F.count("*").alias("n")).drop("run")


def overlaps_previous(windows: DataFrame) -> DataFrame:
    """Whether a window shares a place with the one before."""
    order = Window.orderBy("window_id")
    a, b = F.lag("w_start").over(order), F.lag("w_end").over(order)
    hit = ((a <= F.col("w_start")) & (F.col("w_start") <= b)) | ((F.col("w_start") <= a) & (a <= F.col("w_end")))
    return windows.withColumn("overlaps", F.coalesce(hit, F.lit(False)))


def window_of(text: Column) -> tuple[Column, Column, Column]:
    """Start, end and middle from a name such as x_1000_to_1299.tree; null without them."""
    start, end = (F.nullif(F.regexp_extract(text, r"([0-9]+)_to_([0-9]+)", k), F.lit("")).cast("long") for k in (1, 2))
    return start, end, (start + end) / 2


# -- coordinates -------------------------------------------------------------------------------------------


def aligned_places(bases: DataFrame, key: str = "seq_id", gap: str = "-") -> DataFrame:
    """Of sequences in an alignment (key, pos from 1, base): seq_pos of each place.

    A base has its number; a gap between bases has the number before and a half, before the first base -1, after
    the last NaN.
    """
    base = (F.col("base") != gap).cast("int")
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = bases.withColumn("_n", F.sum(base).over(upto)).withColumn("_all", F.sum(base).over(Window.partitionBy(key)))
    place = F.when(F.col("base") != gap, F.col("_n").cast("double")).when(F.col("_n") == 0, -1.0).when(F.col("_n") == F.col("_all"), float("nan")).otherwise(F.col("_n") + 0.5)
    return rows.withColumn("seq_pos", place).drop("_n", "_all")


def clamped(place: Column, length: Column) -> Column:
    """A translated place as a place of the sequence: halves go down, what lies outside goes to the ends."""
    return F.when(F.isnan(place), length).otherwise(F.least(F.greatest(F.floor(place), F.lit(1)), length))


def sequence_to_alignment(bases: DataFrame, places: DataFrame, key: str = "seq_id") -> DataFrame:
    """Places in a sequence (key, seq_pos) -> pos in the alignment."""
    own = aligned_places(bases, key).where("base <> '-'").select(key, F.col("seq_pos").cast("long").alias("seq_pos"), "pos")
    return places.join(own, [key, "seq_pos"])


# -- interval joins and statistics -------------------------------------------------------------------------


#: Windows that may go to all tasks at once.
FEW = 100_000


def spanning(reads: DataFrame, windows: DataFrame, bin_width: int = 64) -> DataFrame:
    """Reads that span a window: first_pos <= w_start and last_pos >= w_end.

    An equality join on bins of the axis: a window is found in the bin of its start, a read in all bins it
    touches, so no pair is made that doesn't share a bin. Windows are counted first: up to FEW go to all tasks, and
    reads stay where they are; beyond, both sides are shuffled by bin.
    """
    shared_folder(windows.sparkSession)
    w = windows.withColumn("_bin", F.floor(F.col("w_start") / bin_width)).checkpoint()
    w = F.broadcast(w) if w.count() <= FEW else w
    r = reads.where("last_pos >= first_pos").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("first_pos") / bin_width), F.floor(F.col("last_pos") / bin_width))))
    return r.join(w, "_bin").where((F.col("first_pos") <= F.col("w_start")) & (F.col("last_pos") >= F.col("w_end"))).drop("_bin")


def within(points: DataFrame, windows: DataFrame, pos: str = "pos", bin_width: int = 64) -> DataFrame:
    """Points in windows, by the same bins."""
    w = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("w_start") / bin_width), F.floor(F.col("w_end") / bin_width))))
    return points.withColumn("_bin", F.floor(F.col(pos) / bin_width)).join(w, "_bin").where(F.col(pos).between(F.col("w_start"), F.col("w_end"))).drop("_bin")


def window_constants(windows: DataFrame, norm: DataFrame) -> DataFrame:
    """Mean constant of the places in each window; null without any."""
    found = within(norm, windows.select("window_id", "w_start", "w_end")).groupBy("window_id").agg(F.avg("norm_const").alias("norm_const"))
    return windows.join(found, "window_id", "left")


def position_statistics(windows: DataFrame, value: str) -> DataFrame:
    """Every place gets the mean over the windows that cover it."""
    return windows.select(F.explode(F.sequence("w_start", "w_end")).alias("pos"), value).groupBy("pos").agg(F.avg(value).alias(value))


def standardised(norm: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Constants over their mean: of all places, or of lo..hi."""
    part = norm if lo is None else norm.where(F.col("pos").between(lo, hi))
    return norm.crossJoin(F.broadcast(part.agg(F.avg("norm_const").alias("_m")))).withColumn("norm_const", F.col("norm_const") / F.col("_m")).drop("_m")  # one row

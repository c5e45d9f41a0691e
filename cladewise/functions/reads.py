"""Functions on columns of reads: positions (array of int, null where a base has no place) and qualities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_place(positions: Column) -> Column:
    return F.try_element_at(F.filter(positions, lambda p: p.isNotNull()), F.lit(1))


def last_place(positions: Column) -> Column:
    return F.try_element_at(F.filter(positions, lambda p: p.isNotNull()), F.lit(-1))


def _first_index(positions: Column) -> Column:
    """Index from 0 of the first place, -1 without one."""
    return F.array_position(F.transform(positions, lambda p: p.isNotNull()), True).cast("int") - 1


def spans_window(positions: Column, left: Column, right: Column, exact: bool = False) -> Column:
    """Whether the mapped part reaches from left to right; exact: whether it starts and ends there."""
    a, b = first_place(positions), last_place(positions)
    hit = (a == left) & (b == right) if exact else (a <= left) & (b >= right)
    return F.coalesce(hit, F.lit(False))


def recovered_ends(positions: Column) -> Column:
    """Clipped ends (leading and trailing nulls) get the places that follow from the mapped part; they may lie outside the reference."""
    ends = F.struct(_first_index(positions).alias("i"), (F.size(positions) - 1 - _first_index(F.reverse(positions))).alias("j"), first_place(positions).alias("a"), last_place(positions).alias("b"))
    place = lambda e: lambda p, k: F.when(k < e["i"], e["a"] - (e["i"] - k)).when(k > e["j"], e["b"] + (k - e["j"])).otherwise(p)
    return let(ends, lambda e: F.when(e["i"] < 0, positions).otherwise(F.transform(positions, place(e))))


def _range(good: Column) -> Column:
    """a: index from 1 of the first true entry, n: entries up to the last one; 0 without any."""
    a, z = F.array_position(good, True).cast("int"), F.array_position(F.reverse(good), True).cast("int")
    return F.struct(a.alias("a"), F.when(a == 0, 0).otherwise(F.size(good) - z + 1 - a + 1).cast("int").alias("n"))


def trim_range(quals: Column, least: int) -> Column:
    """Index a from 1 of the first base of that quality, and the number n of bases up to the last one; 0 without any."""
    return let(F.transform(quals, lambda q: q >= least), _range)


def low_quality(quals: Column, least: int) -> Column:
    """Two or more bases under the threshold."""
    return F.size(F.filter(quals, lambda q: q < least)) >= 2


def cut_to_window(positions: Column, left: Column, right: Column) -> Column:
    """Index a from 1 and number n of the bases from the first place at or after left to the last at or before right."""
    return let(F.transform(positions, lambda p: F.coalesce((p >= left) & (p <= right), F.lit(False))), _range)


def gap_share(seq: Column, gap: str = "-") -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(gap), F.lit("")))) / F.length(seq)


def distance(a: Column, b: Column) -> Column:
    """Difference of lengths plus mismatches over the common length."""
    n = F.least(F.length(a), F.length(b))
    mismatches = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when((i <= n) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), 1).otherwise(0))
    return F.abs(F.length(a) - F.length(b)) + mismatches


_TIP = r"^(.*)_read_([0-9]+)_count_([0-9]+)$"


def host_of(label: Column, regex: str = _TIP) -> Column:
    return F.nullif(F.regexp_extract(label, regex, 1), F.lit(""))


def reads_of(label: Column, regex: str = _TIP) -> Column:
    return F.nullif(F.regexp_extract(label, regex, 3), F.lit("")).cast("long")


def tip_label(host: Column, rank: Column, count: Column) -> Column:
    return F.concat(host, F.lit("_read_"), rank.cast("string"), F.lit("_count_"), count.cast("string"))

"""Range arithmetic as Column expressions (no Python at run time, all inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x).cast("long")


def width(start, end) -> Column:
    """end - start."""
    return _c(end) - _c(start)


def midpoint(start, end) -> Column:
    """Truncated midpoint of a range with non-negative coordinates."""
    return F.floor((_c(start) + _c(end)) / 2).cast("long")


def valid_range(start, end) -> Column:
    """True for a non-null, non-empty, right-way-round range; never null."""
    return F.coalesce(_c(end) > _c(start), F.lit(False))


def overlaps(s1, e1, s2, e2) -> Column:
    """Strict half-open overlap: touching ranges do not overlap."""
    return (_c(s1) < _c(e2)) & (_c(s2) < _c(e1))


def overlap_width(s1, e1, s2, e2) -> Column:
    """Shared positions, 0 where there are none."""
    return F.greatest(F.lit(0).cast("long"), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def distance_or_overlap(s1, e1, s2, e2) -> Column:
    """Gap as a positive number, 0 for touching ranges, minus the shared width for overlapping ones."""
    return F.greatest(_c(s1), _c(s2)) - F.least(_c(e1), _c(e2))


def overlap_range(s1, e1, s2, e2) -> Column:
    """Struct(start, end) of the intersection; empty at the touching point; null with a gap between."""
    lo, hi = F.greatest(_c(s1), _c(s2)), F.least(_c(e1), _c(e2))
    return F.when(lo <= hi, F.struct(lo.alias("start"), hi.alias("end")))


def genomic_overlap_width(n1, s1, e1, n2, s2, e2) -> Column:
    """overlap_width on the same sequence, else 0."""
    return F.when(_c(n1) == _c(n2), overlap_width(s1, e1, s2, e2)).otherwise(F.lit(0).cast("long"))


def genomic_overlap_range(n1, s1, e1, n2, s2, e2) -> Column:
    """overlap_range on the same sequence, else null."""
    return F.when(_c(n1) == _c(n2), overlap_range(s1, e1, s2, e2))


def container_ok(start, end, length) -> Column:
    """The looser container test: start <= end < length."""
    return F.coalesce((_c(start) <= _c(end)) & (_c(end) < _c(length)), F.lit(False))


def slice_ok(start, end, length) -> Column:
    """The test before slicing: start < end <= length."""
    return F.coalesce((_c(start) < _c(end)) & (_c(end) <= _c(length)), F.lit(False))


def adjusted(start, end, start_delta: int, end_delta: int, length) -> tuple[Column, Column]:
    """Moved bounds, clamped to [0, length]; an empty result has end <= start and is for the caller to drop."""
    zero = F.lit(0).cast("long")
    lo = F.least(F.greatest(_c(start) + F.lit(start_delta), zero), _c(length))
    hi = F.least(F.greatest(_c(end) + F.lit(end_delta), lo), _c(length))
    return lo, hi


def flanks(start, end, left: int | None, right: int | None, length) -> Column:
    """Array of non-empty flank structs, the left one first."""
    zero, sides = F.lit(0).cast("long"), []
    if left is not None:
        sides.append(F.struct(F.lit("left").alias("side"), F.greatest(_c(start) - F.lit(left), zero).alias("start"), F.least(_c(start), _c(length)).alias("end")))
    if right is not None:
        sides.append(F.struct(F.lit("right").alias("side"), F.least(_c(end), _c(length)).alias("start"), F.least(_c(end) + F.lit(right), _c(length)).alias("end")))
    if not sides:
        raise ValueError("flanks needs a left or a right width")
    return F.filter(F.array(*sides), lambda x: x["end"] > x["start"])


def window_starts(length, step: int) -> Column:
    """Array of window starts 0, step, ... below length."""
    return F.when(_c(length) > 0, F.sequence(F.lit(0).cast("long"), _c(length) - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))


def window_ids(start, end, width_: int, step: int) -> Column:
    """Array of the numbers k of the regular windows [k*step, k*step+width) that a range overlaps; no join needed."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((_c(start) - F.lit(width_)) / step).cast("long") + 1)
    last = F.floor((_c(end) - 1) / step).cast("long")
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def natural_key(name) -> Column:
    """Sort key that puts chr2 before chr10: every digit run is padded to a fixed width.

    Digit runs of up to 18 digits order by value; longer ones fall back to text order.
    """
    padded = F.regexp_replace(_c(name), r"(\d+)", "000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{18})(?!\d)", "$1")

"""The score aggregates: sum, sum-not-empty, min, max, mean, median, collapse."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NoOperationError

INF = float("inf")
OPERATIONS = ("sum", "sum-not-empty", "min", "max", "mean", "median", "collapse")


def finite(x: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; null for null."""
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def number_text(x: Column) -> Column:
    """Shortest text of a double, never with an exponent: 2, not 2.0; 12345678.5, not 1.23456785E7; NaN, inf and -inf.

    It always reads back as the same double; beyond 1e17 and below 1e-307 it may have a digit more than it needs.
    """
    s = x.cast("string")
    for places in (16, 15, 14):  # Java 17 gives some numbers more digits than they need
        fewer = F.format_string(f"%.{places}e", x)
        fewer = F.regexp_replace(F.upper(fewer), r"0*E\+?", "E")
        s = F.when((F.length(s) > 16) & (fewer.try_cast("double") == x), fewer).otherwise(s)
    power = F.substring_index(s, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0*$|[-.]", "")
    large = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    spelled = F.concat(F.when(s.startswith("-"), "-").otherwise(""), F.when(power < 0, small).otherwise(large))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == F.lit(INF), F.when(x > 0, "inf").otherwise("-inf")).when(s.contains("E"), spelled).otherwise(F.regexp_replace(s, r"\.0$", ""))


def operation(name: str, x: Column, order: Iterable[Column] = ()) -> Column:
    """Aggregate expression of one operation over the non-null values of x.

    sum of nothing is 0.0, sum-not-empty, min, max, mean and median of nothing are null, collapse is "".
    min and max look at finite values only; sum and mean keep NaN and infinities; the median leaves NaN out
    (infinities stay: they have an order).  collapse orders by ``order``.
    """
    if name == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if name == "sum-not-empty":
        return F.sum(x)
    if name == "min":
        return F.min(F.when(finite(x), x))
    if name == "max":
        return F.max(F.when(finite(x), x))
    if name == "mean":
        return F.avg(x)
    if name == "median":
        return F.median(F.when(~F.isnan(x), x))
    if name == "collapse":
        keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
        rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*keys, x.alias("x")))))
        return F.array_join(F.transform(rows, lambda r: number_text(r["x"])), ",")
    raise NoOperationError(f"unknown operation {name!r}; there are {', '.join(OPERATIONS)}")


def operations(names: Iterable[str], x: Column, order: Iterable[Column] = (), prefix: str = "score_") -> list[Column]:
    """Aliased aggregates for a list of operation names."""
    names, order = list(names), list(order)
    if not names:
        raise NoOperationError("no operation given")
    return [operation(n, x, order).alias(prefix + n.replace("-", "_")) for n in names]


def weighted_mean(x: Column, w: Column) -> Column:
    """Mean of x weighted by w; 0.0 over nothing or zero weight."""
    return F.coalesce(F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))), F.lit(0.0))

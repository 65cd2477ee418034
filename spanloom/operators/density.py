"""Windows x features matrices of covered positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import overlap_width, window_ids
from ..model import END, LENGTH, SEQ, START, RangeFrame, lookup_join
from ..session import cut_lineage
from .disjoin import disjoin
from .merge import merge


def _to_windows(df: DataFrame, seqlens: DataFrame, width: int, step: int, chop: bool, keys: Sequence[str]) -> DataFrame:
    """Positions of each range that fall in each regular window.  The window numbers follow from the coordinates, so
    there is no join with the windows, only one with the genome for its lengths."""
    dim = seqlens.select(F.col(SEQ).alias("_k"), F.col(LENGTH).alias("_len"))
    rows = lookup_join(df, dim, [SEQ], ["_k"], "inner", START).withColumn("_w", F.explode(window_ids(START, F.least(END, "_len"), width, step)))
    lo = F.col("_w") * F.lit(step)
    full = lo + F.lit(width)
    rows = rows.where(full < F.col("_len")) if chop else rows.where(lo < F.col("_len"))
    hi = F.least(full, F.col("_len"))
    bp = overlap_width(START, END, lo, hi)
    out = rows.groupBy(SEQ, lo.alias("_lo"), hi.alias("_hi"), *keys).agg(F.sum(bp).cast("long").alias("bp"))
    return out.where("bp > 0").select(SEQ, F.col("_lo").alias(START), F.col("_hi").alias(END), *keys, "bp")


def feature_density(df: DataFrame, seqlens: DataFrame, width: int, step: int | None = None, chop: bool = False, feature: str = "feature_name") -> DataFrame:
    """Long form (seqname, start, end, feature, bp): positions of a window that some range of the feature covers.

    Ranges of a feature are merged first.  Rows without a feature or with a name outside the genome are left out.
    """
    merged = merge(df.select(SEQ, START, END, F.col(feature).alias("feature")), 0, keys=(SEQ, "feature"))
    return _to_windows(merged, seqlens, width, step or width, chop, ["feature"])


def feature_density_exclusive(df: DataFrame, seqlens: DataFrame, width: int, step: int | None = None, chop: bool = False, feature: str = "feature_name", **kw) -> DataFrame:
    """Long form keyed by the set of features (sorted, comma-joined) that cover a position, each position once."""
    apart = merge(df.where(F.col(feature).isNotNull()).select(SEQ, START, END, F.col(feature).alias("feature")), 0, keys=(SEQ, "feature"))
    segs = disjoin(cut_lineage(apart), "feature", merged=True, **kw)  # used by the segments and by the pairs
    segs = segs.select(SEQ, START, END, F.array_join("labels", ",").alias("feature_set"))
    return _to_windows(segs, seqlens, width, step or width, chop, ["feature_set"])


def column_totals(long: DataFrame, key: str) -> DataFrame:
    """Total positions per matrix column, largest first, then by label."""
    return long.groupBy(key).agg(F.sum("bp").cast("long").alias("total_bp")).orderBy(F.desc("total_bp"), key)


def matrix(long: DataFrame, seqlens: DataFrame, width: int, step: int | None, chop: bool, key: str, columns: Sequence[str] | None = None, most: int = 10_000) -> DataFrame:
    """Wide form: one row per window, one column per feature, 0 where nothing is covered.

    Columns are those given, else all that occur in column_totals order; more than ``most`` raise an error rather
    than being dropped.  No features give the windows alone.
    """
    if columns is None:
        columns = [r[0] for r in column_totals(long, key).limit(most + 1).collect()]
        if len(columns) > most:
            raise ValueError(f"over {most} columns; use the long form")
    windows = RangeFrame.from_windows(seqlens, width, step, chop).df
    if not columns:
        return windows
    wide = long.groupBy(SEQ, START, END).pivot(key, list(columns)).sum("bp")
    return windows.join(wide, [SEQ, START, END], "left").fillna(0, list(columns))

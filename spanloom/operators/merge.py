"""Merging of ranges: by distance, by minimum overlap, and by a condition on the payload."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import END, SEQ, START
from .islands import STRIPE, assign_islands, stripe_of, valid_rows
from .periods import periods


def merge(df: DataFrame, distance: int = 0, aggregates: Sequence[Column] = (), keys: Sequence[str] = (SEQ,), stripe: int = STRIPE, order: Sequence[str] = ()) -> DataFrame:
    """Merge neighbouring ranges of a key and aggregate their payload.

    distance 0 merges overlapping and touching ranges, d > 0 also bridges gaps up to d, d < 0 asks for -d shared
    positions with the row before.  Order is (start, end, *order).  Invalid rows are left out; no rows give none.
    """
    keys = list(keys)
    if distance >= 0 and not aggregates:  # without payload they are the periods of ranges that reach so much further
        far = periods(valid_rows(df, keys).select(*keys, START, (F.col(END) + F.lit(distance)).alias(END)), keys, stripe)
        return far.select(*keys, START, (F.col(END) - F.lit(distance)).alias(END))
    if distance >= 0:
        rows = assign_islands(df, distance, keys, stripe, "_island")
    else:
        rows = fold_islands(df, distance, keys, stripe, order)
    out = rows.groupBy(*keys, "_island").agg(F.max(END).alias("_end"), *aggregates, F.min(START).alias("_start"))
    rest = [c for c in out.columns if c not in {*keys, "_island", "_end", "_start"}]
    return out.select(*keys, F.col("_start").alias(START), F.col("_end").alias(END), *rest)


def fold_islands(df: DataFrame, distance: int, keys: Sequence[str], stripe: int, order: Sequence[str] = (), same: Callable[[dict, dict], bool] | None = None) -> DataFrame:
    """Group numbers by the sequential rule: a row joins the group while it is near the group's running end, and while
    ``same(first row of the group, row)`` holds; a row that does not join replaces the group, even if it ends earlier.

    The rule cannot reach across a position that no range covers (or a gap over ``distance``), so it runs per such
    island.  Islands are handled in blocks by the stripe of their start; memory holds one block.
    """
    keys = list(keys)
    rows = assign_islands(df, max(distance, 0), keys, stripe, "_chunk").withColumn("_block", stripe_of("_chunk", stripe))
    columns = [c for c in rows.columns if c != "_block"]
    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField("_island", T.LongType())])
    by = ["_chunk", START, END, *order]

    def fold(pdf):
        pdf = pdf.sort_values(by, kind="stable").reset_index(drop=True)
        recs = pdf.to_dict("records") if same else None
        chunk, lo, hi = pdf["_chunk"].to_numpy(), pdf[START].to_numpy(), pdf[END].to_numpy()
        ids, group, end, first = [0] * len(pdf), -1, 0, 0
        for i in range(len(pdf)):
            gap = lo[i] - min(end, hi[i]) if group >= 0 and lo[i] >= lo[first] else None
            near = group >= 0 and chunk[i] == chunk[first] and gap is not None and gap <= distance
            if near and (same is None or same(recs[first], recs[i])):
                end = max(end, hi[i])
            else:
                group, end, first = group + 1, hi[i], i
            ids[i] = group
        return pdf[columns].assign(_island=ids)

    out = rows.groupBy(*keys, "_block").applyInPandas(lambda pdf: fold(pdf)[[*columns, "_island"]], schema)
    # group numbers are local to a block: make them unique within the key
    return out.withColumn("_island", F.struct(stripe_of("_chunk", stripe).alias("b"), F.col("_island").alias("g"))).drop("_chunk")


def merge_runs(df: DataFrame, distance: int, by: str, aggregates: Sequence[Column] = (), keys: Sequence[str] = (SEQ,), stripe: int = STRIPE, order: Sequence[str] = ()) -> DataFrame:
    """Merge by distance >= 0 only while neighbours agree on the column ``by`` (null agrees with null).

    Runs follow (start, end, *order): overlapping a, b, a give three groups.  All windows are per island.
    """
    keys = list(keys)
    rows = assign_islands(df, distance, keys, stripe, "_chunk")
    w = Window.partitionBy(*keys, "_chunk").orderBy(START, END, *order)
    rows = rows.withColumn("_turn", F.when(F.row_number().over(w) == 1, 0).otherwise(F.when(F.col(by).eqNullSafe(F.lag(by).over(w)), 0).otherwise(1)))
    rows = rows.withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(*keys, "_chunk", "_run").orderBy(START, END, *order)
    seen = F.max(END).over(r.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", seen).withColumn("_cut", F.when(F.col("_seen").isNull() | (F.col(START) > F.col("_seen") + distance), 1).otherwise(0))
    rows = rows.withColumn("_part", F.sum("_cut").over(r.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "_chunk", "_run", "_part").agg(F.min(START).alias("_start"), F.max(END).alias("_end"), *aggregates)
    rest = [c for c in out.columns if c not in {*keys, "_chunk", "_run", "_part", "_start", "_end"}]
    return out.select(*keys, F.col("_start").alias(START), F.col("_end").alias(END), *rest)


def merge_where(df: DataFrame, distance: int, same: Callable[[dict, dict], bool], aggregates: Sequence[Column] = (), keys: Sequence[str] = (SEQ,), stripe: int = STRIPE, order: Sequence[str] = ()) -> DataFrame:
    """Merge by distance while an arbitrary predicate of (first row of the group, next row) holds."""
    keys = list(keys)
    rows = fold_islands(df, distance, keys, stripe, order, same)
    out = rows.groupBy(*keys, "_island").agg(F.min(START).alias("_start"), F.max(END).alias("_end"), *aggregates)
    rest = [c for c in out.columns if c not in {*keys, "_island", "_start", "_end"}]
    return out.select(*keys, F.col("_start").alias(START), F.col("_end").alias(END), *rest)

"""Order, positions and dictionary codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import natural_key
from ..model import END, ORD, SEQ, START, lookup_join
from ..session import cut_lineage


def sort_ranges(df: DataFrame, seqlens: DataFrame | None = None, *more: str) -> DataFrame:
    """Range sort by genome order (or natural name order), start, end."""
    if seqlens is None:
        return df.orderBy(natural_key(SEQ), START, END, *more)
    out = lookup_join(df, seqlens.select(F.col(SEQ).alias("_k"), F.col(ORD).alias("_ord")), [SEQ], ["_k"], "left", START)
    return out.orderBy(F.col("_ord").asc_nulls_last(), natural_key(SEQ), START, END, *more).drop("_k", "_ord")


def range_positions(df: DataFrame, seqlens: DataFrame, *more: str, name: str = "position") -> DataFrame:
    """Number the rows in the order of sort_ranges, names outside the genome at the end; ``more`` must make it total."""
    dim = seqlens.select(F.col(SEQ).alias("_k"), F.col(ORD).alias("_ord"))
    rows = lookup_join(df, dim, [SEQ], ["_k"], "left", more[0] if more else START).drop("_k")
    rows = rows.withColumns({"_out": F.col("_ord").isNull(), "_name": natural_key(SEQ)})
    return with_position(rows, ["_out", "_ord", "_name", START, END, *more], name).drop("_out", "_ord", "_name")


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, ... under an order that is total: a range sort, counts per partition, offsets.

    Only one count per partition reaches a single task.
    """
    # the range bounds come from a sample, so the split is written once: both uses below must see the same one
    rows = cut_lineage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offset = counts.select(F.col("_pid").alias("_o"), F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1)
    return rows.join(F.broadcast(offset), F.col("_pid") == F.col("_o")).withColumn(name, (F.col("_off") + F.col("_rn")).cast("long")).drop("_pid", "_o", "_off", "_rn")


def dictionary(df: DataFrame, key: str, order: str, name: str = "code") -> DataFrame:
    """(key, code) with codes 0, 1, ... in order of first appearance under ``order``; null keys get no code."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return with_position(first, ["_first", key], name).select(key, name)


def encode(df: DataFrame, key: str, order: str, name: str = "code") -> DataFrame:
    """Rows with the dictionary code of their key (null for null)."""
    codes = dictionary(df, key, order, name).withColumnRenamed(key, "_dk")
    return df.join(codes, df[key] == codes["_dk"], "left").drop("_dk")


def ranges_by_sequence(df: DataFrame) -> DataFrame:
    """Row count, first start and last end per sequence."""
    return df.groupBy(SEQ).agg(F.count(F.lit(1)).alias("n"), F.min(START).alias("first_start"), F.max(END).alias("last_end"))

"""Gaps and islands without a task per key.

Starts are cut into stripes of fixed width, so a key with a third of all rows spreads over as many tasks as it has
stripes, and a stripe with a third of all rows is at most as many distinct starts as it is wide.  What one stripe must know of those before it is one number, the largest end so far; that
comes from a table with one row per key and stripe, over which a window per key is small.  No range is copied into
several stripes, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import END, SEQ, START

#: Positions of a stripe; also the most distinct starts that one stripe can hold.
STRIPE = 1 << 18


def stripe_of(start, stripe: int):
    return F.floor(F.col(start) / F.lit(stripe)).cast("long")


def carry_in(df: DataFrame, keys: Sequence[str], end: str = END) -> DataFrame:
    """Per key and stripe, the largest end in earlier stripes (null in the first): (keys, _stripe, _carry)."""
    before = Window.partitionBy(*keys).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(*keys, "_stripe").agg(F.max(end).alias("_most")).select(*keys, "_stripe", F.max("_most").over(before).alias("_carry"))


def valid_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = df.where(F.coalesce(F.col(END) > F.col(START), F.lit(False)))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows


def assign_islands(df: DataFrame, distance: int = 0, keys: Sequence[str] = (SEQ,), stripe: int = STRIPE, name: str = "island_start") -> DataFrame:
    """Add the start of the island that each row belongs to.

    Rows of one key belong together while the gap from the running maximum of the ends to the next start is at most
    ``distance`` (>= 0).  Rows with a null key or bound and empty or inverted rows are left out.  Islands are found
    over the distinct starts with their largest end, which are at most ``stripe`` per stripe however many rows lie
    there, and joined back to the rows by key and start.
    """
    if distance < 0:
        raise ValueError("negative distances need the ordered fold, see merge")
    keys = list(keys)
    rows = valid_rows(df.drop(name), keys)
    shape = rows.groupBy(*keys, START).agg(F.max(END).alias(END))
    return rows.join(shape_islands(shape, distance, keys, stripe, name).select(*keys, START, name), [*keys, START])


def shape_islands(shape: DataFrame, distance: int, keys: Sequence[str], stripe: int, name: str) -> DataFrame:
    """assign_islands for valid rows with distinct starts per key."""
    keys = list(keys)
    rows = shape.withColumn("_stripe", stripe_of(START, stripe))
    rows = rows.join(carry_in(rows, keys), [*keys, "_stripe"])
    order = Window.partitionBy(*keys, "_stripe").orderBy(START)
    seen = F.greatest(F.col("_carry"), F.max(END).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_seen", seen)
    rows = rows.withColumn("_new", F.when(F.col("_seen").isNull() | (F.col(START) > F.col("_seen") + F.lit(distance)), F.col(START)))
    rows = rows.withColumn("_own", F.last("_new", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    opened = rows.groupBy(*keys, "_stripe").agg(F.max("_new").alias("_last")).select(*keys, "_stripe", F.last("_last", True).over(before).alias("_open"))
    return rows.join(opened, [*keys, "_stripe"]).withColumn(name, F.coalesce("_own", "_open")).drop("_stripe", "_carry", "_seen", "_new", "_own", "_open")


def next_position(df: DataFrame, keys: Sequence[str], position: str, name: str = "_next", stripe: int = STRIPE) -> DataFrame:
    """Add the next larger row's position within the key: lead() in the stripe, else the first of the next stripe."""
    keys = list(keys)
    rows = df.withColumn("_stripe", stripe_of(position, stripe))
    follow = Window.partitionBy(*keys).orderBy("_stripe")
    firsts = rows.groupBy(*keys, "_stripe").agg(F.min(position).alias("_first")).select(*keys, "_stripe", F.lead("_first").over(follow).alias("_after"))
    rows = rows.withColumn("_lead", F.lead(position).over(Window.partitionBy(*keys, "_stripe").orderBy(position)))
    return rows.join(firsts, [*keys, "_stripe"]).withColumn(name, F.coalesce("_lead", "_after")).drop("_stripe", "_lead", "_after")

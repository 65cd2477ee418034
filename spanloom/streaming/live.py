"""Range operators on streams.

Row-wise operators run on streaming DataFrames as they are; joins with a fixed table are stream-static.  Merging needs
state: intervals of event time close when the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import arith
from ..model import END, LENGTH, SEQ, START, lookup_join
from ..operators import hotkeys, join, quantiles


def with_genome(stream: DataFrame, seqlens: DataFrame, name: str = "_len") -> DataFrame:
    """Rows on known sequences with their length (stream-static join, state-free)."""
    dim = seqlens.select(F.col(SEQ).alias("_k"), F.col(LENGTH).alias(name))
    return lookup_join(stream, dim, [SEQ], ["_k"], "inner", START).drop("_k")


def filter_chroms(stream: DataFrame, seqlens: DataFrame) -> DataFrame:
    return with_genome(stream, seqlens).drop("_len")


def adjust(stream: DataFrame, seqlens: DataFrame, start_delta: int, end_delta: int) -> DataFrame:
    lo, hi = arith.adjusted(START, END, start_delta, end_delta, "_len")
    rows = with_genome(stream, seqlens).withColumns({"_lo": lo, "_hi": hi}).where("_hi > _lo")
    return rows.withColumns({START: F.col("_lo"), END: F.col("_hi")}).drop("_lo", "_hi", "_len")


def flank(stream: DataFrame, seqlens: DataFrame, left: int | None, right: int | None) -> DataFrame:
    rows = with_genome(stream, seqlens).withColumn("_f", F.explode(arith.flanks(START, END, left, right, "_len")))
    return rows.withColumns({START: F.col("_f.start"), END: F.col("_f.end")}).drop("_f", "_len")


def overlaps_with(stream: DataFrame, fixed: DataFrame, bin_size: int, levels: int = 1) -> DataFrame:
    """Inner overlap join of a stream with a fixed table; bins have to be given, as a stream has no statistics."""
    return join.overlap_pairs(stream, fixed, bin_size, levels)


def window_counts(stream: DataFrame, time: str, late: str, window: str, keys: Sequence[str] = (SEQ,)) -> DataFrame:
    """Rows per key and window of event time; rows later than the watermark are dropped by the engine."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def merge_periods(stream: DataFrame, time: str, duration: Column, late: str, keys: Sequence[str]) -> DataFrame:
    """Overlapping event-time intervals merged per key by session windows with a duration per row."""
    s = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, duration).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*keys, F.col("_w.start").alias("period_start"), F.col("_w.end").alias("period_end"), "n")


def each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A batch operator (merge, disjoin, density) on every micro-batch."""
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint)


def heavy_state(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compact states of a micro-batch, to be added to those stored."""
    return hotkeys.key_state(batch, keys)


def percentile_partials(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sketch cells of a stream's rows; append them to a table and merge with quantiles.combine."""
    return quantiles.partials(stream, keys, value)

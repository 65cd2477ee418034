"""Per-position data in chunks, sliced by ranges, and array payloads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import slice_ok
from ..model import END, SEQ, START

#: Positions of a chunk.
CHUNK = 1 << 16


def chunk_text(df: DataFrame, text: str, chunk: int = CHUNK, key: str = SEQ) -> DataFrame:
    """(key, chunk number, chunk_text, total length) so that no row carries a whole sequence through a shuffle."""
    n = F.length(text)
    ids = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias(SEQ), F.explode(ids).alias("chunk"), F.col(text).alias("_t"), n.cast("long").alias("total")).select(SEQ, F.col("chunk").cast("long").alias("chunk"), F.expr(f"substring(_t, chunk * {chunk} + 1, {chunk})").alias("chunk_text"), "total")


def chunk_array(df: DataFrame, values: str, chunk: int = CHUNK, key: str = SEQ) -> DataFrame:
    """The same for an array per sequence; for matrices each element is a row array and the length counts rows."""
    n = F.size(values)
    ids = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.where(F.col(values).isNotNull()).select(F.col(key).alias(SEQ), F.explode(ids).alias("chunk"), F.col(values).alias("_v"), n.cast("long").alias("total")).select(SEQ, F.col("chunk").cast("long").alias("chunk"), F.slice("_v", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("chunk_values"), "total")


def sequence_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(SEQ).agg(F.max("total").alias("seq_length"))


def region_slices(ranges: DataFrame, chunks: DataFrame, chunk: int = CHUNK, name: str = "slice", out_of_bounds: str = "raise") -> DataFrame:
    """Rows of ``ranges`` with their slice of the sequence, put together from the chunks that they touch.

    ``ranges`` needs a unique column rid.  A range past the end raises at run time, or is dropped with "drop";
    ranges on unknown sequences are dropped.
    """
    array = "chunk_values" in chunks.columns
    c = F.lit(chunk)
    want = ranges.where(F.col(END) > F.col(START)).select("rid", SEQ, START, END, F.explode(F.sequence(F.floor(F.col(START) / c).cast("long"), F.floor((F.col(END) - 1) / c).cast("long"))).alias("chunk"))
    got = want.join(chunks, [SEQ, "chunk"])
    ok = slice_ok(START, END, "total")
    if out_of_bounds == "drop":
        got = got.where(ok)
    lo = F.greatest(F.col(START) - F.col("chunk") * c, F.lit(0)).cast("int")
    hi = F.least(F.col(END) - F.col("chunk") * c, c).cast("int")
    piece = F.slice("chunk_values", lo + 1, hi - lo) if array else F.substring("chunk_text", lo + 1, hi - lo)
    if out_of_bounds != "drop":  # part of the slice itself, so that column pruning cannot take the check away
        kind = chunks.schema["chunk_values" if array else "chunk_text"].dataType
        piece = F.when(ok, piece).otherwise(F.raise_error(F.lit("range exceeds its sequence")).cast(kind))
    parts = F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("k"), piece.alias("p"))))
    whole = F.transform(parts, lambda x: x["p"])
    whole = F.flatten(whole) if array else F.array_join(whole, "")
    return ranges.join(got.groupBy("rid").agg(whole.alias(name)), "rid")


def region_map(ranges: DataFrame, chunks: DataFrame, f: Callable[[Column], Column], name: str = "value", **kw) -> DataFrame:
    """A Column function of the slice for each range."""
    return region_slices(ranges, chunks, name="_slice", **kw).withColumn(name, f(F.col("_slice"))).drop("_slice")


def into_array(df: DataFrame, columns: Sequence[str | Column], name: str = "values", ncols: int | None = None) -> DataFrame:
    """Payload columns as one fixed-width double array; a wrong width is an error while the plan is built."""
    if ncols is not None and ncols != len(columns):
        raise ValueError(f"{len(columns)} columns for rows of {ncols}")
    return df.withColumn(name, F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]))


def check_width(df: DataFrame, column: str, ncols: int) -> DataFrame:
    """Raise at run time for rows whose array has another length."""
    return df.withColumn(column, F.when(F.size(column) == ncols, F.col(column)).otherwise(F.raise_error(F.lit("ragged array")).cast(df.schema[column].dataType)))


def array_value(column: str, i: int) -> Column:
    """Element i (0-based) of a row's array, null outside."""
    return F.get(F.col(column), F.lit(i))


def column_sums(df: DataFrame, column: str, ncols: int) -> DataFrame:
    """(position, total) of each array position over all rows."""
    return df.select(F.posexplode(column).alias("position", "_x")).where(F.col("position") < ncols).groupBy("position").agg(F.sum("_x").alias("total"))

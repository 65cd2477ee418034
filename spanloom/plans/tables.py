"""Loading of the test tables and the range views that several queries share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import valid_range
from ..model import END, SEQ, START, known


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; its schema is read from the files once for as long as they stay the same."""
    path = f"{folder}/{name}.parquet"
    files = [] if "://" in path else [Path(path)] if Path(path).is_file() else sorted(Path(path).rglob("*.parquet"))
    if not 0 < len(files) <= 1000:
        return spark.read.parquet(path)
    key = "schema", path, *((str(f), f.stat().st_size, f.stat().st_mtime) for f in files)
    return spark.read.schema(known(key, lambda: spark.read.parquet(path).schema)).parquet(path)


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.col(SEQ).isNotNull() & valid_range(START, END))


def bed3(spark: SparkSession, folder: str) -> DataFrame:
    return valid(table(spark, folder, "bed3_ranges").select("rid", SEQ, START, END))


def bed5(spark: SparkSession, folder: str) -> DataFrame:
    return valid(table(spark, folder, "bed5_ranges").select("rid", SEQ, START, END, "feature_name", "score"))


def seqlens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per name: the longest length among the rows that are not removed, over all genomes."""
    s = table(spark, folder, "seqlens").where(F.col("removed_at").isNull() & F.col(SEQ).isNotNull())
    return s.groupBy(SEQ).agg(F.max("seq_length").alias("seq_length"), F.min("ord").alias("ord"))


# The same views for SQL.
BED3 = "(SELECT rid, seqname, range_start, range_end FROM bed3_ranges WHERE seqname IS NOT NULL AND range_end > range_start)"
BED5 = "(SELECT rid, seqname, range_start, range_end, feature_name, score FROM bed5_ranges WHERE seqname IS NOT NULL AND range_end > range_start)"
SEQLENS = "(SELECT seqname, max(seq_length) AS seq_length, min(ord) AS ord FROM seqlens WHERE removed_at IS NULL AND seqname IS NOT NULL GROUP BY seqname)"

"""Tab-separated output."""

from __future__ import annotations

import gzip
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.agg import number_text
from ..operators.ordering import sort_ranges


@dataclass(frozen=True)
class TsvConfig:
    """What a missing value reads, the header names and comment lines, and whether the header starts with #."""

    no_value: str = "NA"
    headers: Sequence[str] | None = None
    metadata: Sequence[str] = field(default_factory=tuple)
    hash_header: bool = False


BED_TSV = TsvConfig(no_value=".")


def text_of(df: DataFrame, column: str, no_value: str) -> Column:
    """A value as text: the shortest form of a number, comma-joined arrays, ``no_value`` for null."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = number_text(c.cast("double"))
    elif isinstance(kind, T.ArrayType):
        num = isinstance(kind.elementType, (T.DoubleType, T.FloatType))
        c = F.array_join(F.transform(c, lambda x: number_text(x.cast("double")) if num else x.cast("string")), ",")
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit(no_value))


def to_lines(df: DataFrame, config: TsvConfig = BED_TSV) -> DataFrame:
    """One column ``value`` of tab-joined text."""
    return df.select(F.concat_ws("\t", *[text_of(df, c, config.no_value) for c in df.columns]).alias("value"))


def _top(config: TsvConfig) -> list[str]:
    out = [f"#{m}" for m in config.metadata]
    if config.headers:
        out.append(("#" if config.hash_header else "") + "\t".join(config.headers))
    return out


def write_tsv(df: DataFrame, path: str | None = None, config: TsvConfig = BED_TSV, seqlens: DataFrame | None = None, ordered: bool = True) -> int:
    """One file (gzip if it ends in .gz) or standard output, in range order; rows are streamed, never held. Returns rows."""
    if ordered and {"seqname", "range_start", "range_end"} <= set(df.columns):
        df = sort_ranges(df, seqlens)
    n, out = 0, sys.stdout if path is None else gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")
    try:
        for line in _top(config):
            out.write(line + "\n")
        for row in to_lines(df, config).toLocalIterator():
            out.write(row[0] + "\n")
            n += 1
    finally:
        if path is not None:
            out.close()
    return n


def write_tsv_folder(df: DataFrame, path: str, config: TsvConfig = BED_TSV, seqlens: DataFrame | None = None, compress: bool = False) -> None:
    """The scalable form: a folder of parts in range order, written by the executors; the top lines go beside them."""
    rows = sort_ranges(df, seqlens) if {"seqname", "range_start", "range_end"} <= set(df.columns) else df
    writer = to_lines(rows, config).write.mode("error")
    (writer.option("compression", "gzip") if compress else writer).text(path)
    if top := _top(config):  # a file whose name readers of the folder skip, on whatever storage the folder is
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path, "_header")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(("\n".join(top) + "\n").encode()))
        out.close()


class Report:
    """Messages of a command, each once with its count."""

    def __init__(self):
        self.issues: dict[str, int] = {}

    def add_issue(self, message: str, n: int = 1) -> None:
        if n:
            self.issues[message] = self.issues.get(message, 0) + n

    def lines(self) -> list[str]:
        return [m if n == 1 else f"{m} ({n} times)" for m, n in self.issues.items()]

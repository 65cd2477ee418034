"""Sources of per-position data: FASTA, indexed FASTA and numeric arrays, all in chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import RangeFrame, lookup_join
from ..operators.sequences import CHUNK, chunk_array


def read_fasta(spark: SparkSession, path: str, names: Sequence[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(seqname, chunk, chunk_text, total) of a FASTA file, gzip by extension; a name ends at the first white space.

    The file is read line by line, and no row ever holds more than a line or a chunk: lines carry their place in the file,
    a header's place opens its sequence, and running sums of line lengths give the position of each line.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    rows = _with_place(lines)
    head = F.col("value").startswith(">")
    part = Window.partitionBy("block").orderBy("nth")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"name": F.when(head, F.regexp_extract("value", r"^>(\S*)", 1)), "text": F.when(head, "").otherwise(F.regexp_replace("value", r"\s", ""))})
    rows = rows.withColumns({"opened": F.last(F.when(head, F.col("nth")), True).over(upto), "own": F.last("name", True).over(upto)})
    rows = rows.withColumn("before", F.sum(F.length("text")).over(Window.partitionBy("block", "opened").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)) - F.length("text"))
    # what a block must know of those before it: the sequence that is open, and how much of it they hold
    ends = rows.groupBy("block").agg(F.max_by("own", "nth").alias("last"), F.max("opened").alias("at"), F.sum(F.when(F.col("opened").isNull(), F.length("text")).otherwise(0)).alias("head"), F.max_by(F.col("before") + F.length("text"), "nth").alias("tail"))
    order = Window.partitionBy(F.col("block.file_path")).orderBy(F.col("block.file_block_start"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"open": F.last("last", True).over(earlier), "n": F.count("last").over(earlier)})
    run = Window.partitionBy(F.col("block.file_path"), "n").orderBy(F.col("block.file_block_start"))
    carried = F.when(F.col("at").isNull(), F.col("head")).otherwise(F.lit(0))
    ends = ends.withColumn("_since", F.coalesce(F.sum(carried).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.withColumn("_tail", F.last(F.when(F.col("at").isNotNull(), F.col("tail")), True).over(earlier))
    ends = ends.select(F.col("block").alias("_b"), "open", (F.col("_since") + F.coalesce("_tail", F.lit(0))).alias("offset"))
    rows = rows.join(ends, F.col("block") == F.col("_b"))
    whose = F.coalesce("own", "open")
    at = F.col("before") + F.when(F.col("opened").isNull(), F.col("offset")).otherwise(0)
    pieces = rows.where(whose.isNotNull() & (F.length("text") > 0)).select(whose.alias("seqname"), at.cast("long").alias("at"), "text")
    if names is not None:
        pieces = pieces.where(F.col("seqname").isin(list(names)))
    return _chunks_of(pieces, chunk)


def _with_place(lines: DataFrame) -> DataFrame:
    """Lines with the split that they come from and their number in it, in file order: a split is one task's run of lines."""
    numbered = lines.select("value", F.struct("file_path", "file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return numbered


def _chunks_of(pieces: DataFrame, chunk: int) -> DataFrame:
    """Stretches of text with their position put together to chunks."""
    c, n = F.lit(chunk).cast("long"), F.length("text")
    cut = pieces.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / c), F.floor((F.col("at") + n - 1) / c))))
    lo, hi = F.greatest(F.col("k") * c, F.col("at")), F.least((F.col("k") + 1) * c, F.col("at") + n)
    cut = cut.select("seqname", F.col("k").cast("long").alias("chunk"), F.struct(lo.alias("lo"), F.substring("text", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("t")).alias("p"), hi.alias("hi"))
    out = cut.groupBy("seqname", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "").alias("chunk_text"), F.max("hi").alias("_hi"))
    total = cut.groupBy(F.col("seqname").alias("_q")).agg(F.max("hi").cast("long").alias("total"))
    return lookup_join(out, total, ["seqname"], ["_q"], "inner", "chunk").select("seqname", "chunk", "chunk_text", "total")


def read_fai(path: str | Path) -> list[tuple[str, int, int, int, int]]:
    """Index rows (name, length, offset, bases per line, bytes per line)."""
    rows = []
    for line in Path(path).read_text().splitlines():
        name, *rest = line.split("\t")
        rows.append((name, *map(int, rest[:4])))
    return rows


def fai_seqlens(spark: SparkSession, path: str | Path) -> DataFrame:
    return RangeFrame.seqlens_from(spark, [(r[0], r[1]) for r in read_fai(path)])


def read_indexed_fasta(spark: SparkSession, path: str, names: Sequence[str] | None = None, chunk: int = CHUNK, index: str | None = None) -> DataFrame:
    """The same from an uncompressed FASTA with its .fai: each task seeks to the bytes of its chunks.

    The file must be reachable from all executors; sequences that are not named are never read.
    """
    rows = [r for r in read_fai(index or path + ".fai") if names is None or r[0] in set(names)]
    work = spark.createDataFrame(rows, "seqname string, total long, offset long, bases long, width long")
    work = work.where("total > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / chunk).cast("long"))))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                d, out = b.to_pydict(), []
                for total, offset, bases, width, k in zip(d["total"], d["offset"], d["bases"], d["width"], d["chunk"]):
                    lo, hi = k * chunk, min(total, (k + 1) * chunk)
                    start, end = offset + lo // bases * width + lo % bases, offset + (hi - 1) // bases * width + (hi - 1) % bases + 1
                    f.seek(start)
                    out.append(f.read(end - start).replace(b"\n", b"").replace(b"\r", b"").decode())
                yield pa.record_batch([b.column(0), b.column(5), pa.array(out, pa.string()), b.column(1)], ["seqname", "chunk", "chunk_text", "total"])

    return work.repartition(max(1, spark.sparkContext.defaultParallelism), "seqname", "chunk").mapInArrow(load, "seqname string, chunk long, chunk_text string, total long")


def numeric_in_memory(spark: SparkSession, arrays: dict[str, np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """(seqname, chunk, chunk_values, total) of 1-D or 2-D arrays; a 2-D array's length is its number of rows."""
    two = any(np.ndim(a) == 2 for a in arrays.values())
    kind = "array<array<double>>" if two else "array<double>"
    rows = [(k, np.asarray(a, float).tolist()) for k, a in arrays.items()]
    return chunk_array(spark.createDataFrame(rows, f"seqname string, v {kind}"), "v", chunk)


def numeric_files(spark: SparkSession, folder: str, pattern: str, names: Sequence[str], loader: Callable[[str], np.ndarray] = np.load, two_d: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The same from one file per sequence, folder/pattern with {} for the name, loaded in the tasks."""
    kind = "array<array<double>>" if two_d else "array<double>"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                a = np.asarray(loader(f"{folder}/{pattern.replace('{}', name)}"), float)
                n = len(a)
                for k in range(-(-n // chunk)):
                    part = a[k * chunk : (k + 1) * chunk].tolist()
                    t = pa.list_(pa.list_(pa.float64())) if two_d else pa.list_(pa.float64())
                    yield pa.record_batch([pa.array([name]), pa.array([k]), pa.array([part], t), pa.array([n])], ["seqname", "chunk", "chunk_values", "total"])

    src = spark.createDataFrame([(n,) for n in names], "seqname string").repartition(max(1, len(names)), "seqname")
    return src.mapInArrow(load, f"seqname string, chunk long, chunk_values {kind}, total long")

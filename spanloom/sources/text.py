"""Line-based sources: genome files, BED3/4/5, BED-like and typed TSV, with detection of what a file is."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnTypeError, EmptyFileError, GenomeFileError, TooFewColumnsError, UnsupportedFormatError
from ..model import END, SEQ, START, RangeFrame

L, S, D = T.LongType(), T.StringType(), T.DoubleType()
BED3 = T.StructType([T.StructField(SEQ, S), T.StructField(START, L), T.StructField(END, L)])
BED4 = T.StructType([*BED3.fields, T.StructField("feature_name", S)])
BED5 = T.StructType([*BED4.fields, T.StructField("score", D)])
BEDLIKE = T.StructType([*BED3.fields, T.StructField("rest", S)])
#: What stands for a missing score.
MISSING = (".",)
GZIP = b"\x1f\x8b"


# ---- the driver's look at a file --------------------------------------------------------------------------------
def first_bytes(path: str | Path, n: int) -> bytes:
    """The first n bytes of a file, from the driver's disk or, for a path with a scheme, from any storage that Spark reads."""
    if "://" not in str(path):
        with open(path, "rb") as f:
            return f.read(n)
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def is_gzipped(path: str | Path) -> bool:
    """By the first two bytes, not the name; a file of under two bytes is an error."""
    head = first_bytes(path, 2)
    if len(head) < 2:
        raise EmptyFileError(f"{path} has under two bytes")
    return head == GZIP


def head_lines(path: str | Path) -> Iterator[str]:
    """Lines of a file one after the other; no more of it is read than what they need, times four at most."""
    gz, n, done = is_gzipped(path), 1 << 16, 0
    while True:
        raw = first_bytes(path, n)
        text = zlib.decompressobj(31).decompress(raw) if gz else raw
        whole = len(raw) < n
        lines = text.split(b"\n")
        if not whole or not lines[-1]:
            lines.pop()  # not read to its end, or nothing after the last line
        for line in lines[done:]:
            yield line.decode()
        if whole:
            return
        n, done = 4 * n, max(done, len(lines))


def first_lines(path: str | Path, comment: str | None = "#", limit: int = 1) -> list[str]:
    """The first lines that are no comments, without reading on."""
    return list(islice((x for x in head_lines(path) if comment is None or not x.startswith(comment)), limit))


def base_extension(path: str | Path) -> str | None:
    """bed for x.bed and x.bed.gz; None without an extension."""
    parts = Path(path).name.split(".")
    if len(parts) > 2 and parts[-1] in ("gz", "bgz"):
        parts = parts[:-1]
    return parts[-1] if len(parts) > 1 else None


def _unsigned(text: str) -> bool:
    return text.isascii() and text.isdigit()


def valid_bedlike(path: str | Path) -> bool:
    """True if the first record has three columns and unsigned positions."""
    lines = first_lines(path)
    parts = lines[0].split("\t") if lines else []
    return len(parts) >= 3 and _unsigned(parts[1]) and _unsigned(parts[2])


def _reads_as(parts: Sequence[str], n: int) -> bool:
    if len(parts) < n or not (_unsigned(parts[1]) and _unsigned(parts[2])):
        return False
    if n < 5 or parts[4] in MISSING:
        return True
    try:
        float(parts[4])
    except ValueError:
        return False
    return True


def detect(path: str | Path) -> str:
    """'bed5', 'bed4', 'bed3' or 'bedlike', from the extension and the first record."""
    ext = base_extension(path)
    if ext is None:
        raise UnsupportedFormatError(f"{path} has no extension")
    lines = first_lines(path)
    if not lines:
        raise EmptyFileError(f"{path} has no records")
    parts = lines[0].split("\t")
    if ext == "tsv" and valid_bedlike(path):
        return "bedlike"
    if ext == "bed":
        for n in (5, 4, 3):
            if _reads_as(parts, n):
                return f"bed{n}"
    if valid_bedlike(path):
        return "bedlike"
    raise UnsupportedFormatError(f"{path} is neither BED nor BED-like")


def after_preamble(lines: DataFrame, p: Preamble, line: str = "value", comment: str = "#") -> DataFrame:
    """The lines that follow a file's preamble: neither comments nor its header."""
    rows = lines.where(~F.col(line).startswith(comment))
    return rows if p.header is None else rows.where(F.col(line) != p.header)


@dataclass(frozen=True)
class Preamble:
    metadata: list[str]
    header: str | None
    columns: int


def preamble(path: str | Path, comment: str = "#", header: str | None = None) -> Preamble:
    """Comment lines at the top, the header (the first line that starts with ``header``) and the number of columns."""
    meta, head = [], None
    for line in head_lines(path):
        if line.startswith(comment):
            meta.append(line)
        elif header is not None and head is None and line.startswith(header):
            head = line
        else:
            return Preamble(meta, head, len(line.split("\t")))
    raise EmptyFileError(f"{path} has no records")


def read_seqlens(spark: SparkSession, path: str | Path) -> DataFrame:
    """A genome file: name and length per line, order kept, no comments; parsed here, as it is small."""
    found: dict[str, int] = {}
    for n, line in enumerate(head_lines(path), 1):
        parts = line.rstrip("\r").split("\t")
        if len(parts) < 2 or not _unsigned(parts[1]):
            raise GenomeFileError(f"{path}, line {n}: no name and length")
        if parts[0] in found:
            raise GenomeFileError(f"{path}, line {n}: {parts[0]} again")
        found[parts[0]] = int(parts[1])
    return RangeFrame.seqlens_from(spark, found)


# ---- lines to columns -------------------------------------------------------------------------------------------
def parse_column(text: Column, kind: T.DataType, missing: Sequence[str] = (), strict: bool = True) -> Column:
    """One field: null for a missing mark; what does not parse raises at run time, or is null if not strict."""
    value = text if isinstance(kind, T.StringType) else text.try_cast(kind)
    if strict and not isinstance(kind, T.StringType):
        value = F.when(value.isNotNull() | text.isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{ColumnTypeError.__doc__} ({kind.simpleString()}): "), text)).cast(kind))
    return F.when(text.isin(list(missing)), F.lit(None).cast(kind)).otherwise(value) if missing else value


def parse_lines(df: DataFrame, schema: T.StructType, line: str = "value", comment: str | None = "#", missing: dict[str, Sequence[str]] | None = None, remainder: str | None = None, strict: bool = True) -> DataFrame:
    """Tab-separated lines as typed columns, prefix-wise: surplus columns are ignored, or kept unsplit in ``remainder``.

    Comment and empty lines are skipped.  A line that is too short raises at run time (null columns if not strict).
    """
    named = [f for f in schema.fields if f.name != remainder]
    text = F.regexp_replace(F.col(line), r"\s+$", "") if remainder else F.regexp_replace(F.col(line), "\r$", "")
    rows = df.where(F.col(line) != "")
    if comment:
        rows = rows.where(~F.col(line).startswith(comment))
    parts = F.split(text, "\t", len(named) + 1)
    rows = rows.withColumn("_p", parts)
    if strict:
        short = F.raise_error(F.concat(F.lit(f"{TooFewColumnsError.__doc__} "), F.col(line))).cast("array<string>")
        rows = rows.withColumn("_p", F.when(F.size("_p") >= len(named), F.col("_p")).otherwise(short))
    cols = [parse_column(F.get("_p", F.lit(i)), f.dataType, (missing or {}).get(f.name, ()), strict).alias(f.name) for i, f in enumerate(named)]
    if remainder:
        cols.append(F.get("_p", F.lit(len(named))).alias(remainder))
    return rows.select(*[c for c in df.columns if c != line], *cols)


def read_lines(spark: SparkSession, path: str | Path) -> DataFrame:
    """Lines of a file or folder as column ``value``; a gzip file whose name does not say so is unpacked in a task, block by
    block, and cut at line feeds only, as Spark cuts plain files (there also at carriage returns)."""
    p = Path(path)
    if "://" in str(path) or not p.is_file() or p.suffix == ".gz" or p.stat().st_size < 2 or not is_gzipped(p):
        return spark.read.text(str(path))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place in b.column(0).to_pylist():
                rest = b""
                with gzip.open(place, "rb") as f:
                    while block := f.read(4 << 20):
                        *lines, rest = (rest + block).split(b"\n")
                        yield pa.record_batch([pa.array([x.removesuffix(b"\r").decode() for x in lines], pa.string())], ["value"])
                if rest:
                    yield pa.record_batch([pa.array([rest.removesuffix(b"\r").decode()], pa.string())], ["value"])

    return spark.createDataFrame([(str(p.resolve()),)], "place string").mapInArrow(unpack, "value string")


def read_tsv(spark: SparkSession, path, schema: T.StructType, missing: dict[str, Sequence[str]] | None = None, strict: bool = True) -> DataFrame:
    return parse_lines(read_lines(spark, path), schema, missing=missing, strict=strict)


def read_bed3(spark, path, **kw) -> DataFrame:
    return read_tsv(spark, path, BED3, **kw)


def read_bed4(spark, path, **kw) -> DataFrame:
    return read_tsv(spark, path, BED4, **kw)


def read_bed5(spark, path, **kw) -> DataFrame:
    """"." is a missing score; a name "." stays a name."""
    return read_tsv(spark, path, BED5, missing={"score": MISSING}, **kw)


def read_bedlike(spark, path, **kw) -> DataFrame:
    return parse_lines(read_lines(spark, path), BEDLIKE, remainder="rest", **kw)


READERS = {"bed3": read_bed3, "bed4": read_bed4, "bed5": read_bed5, "bedlike": read_bedlike}


def read_ranges(spark: SparkSession, path: str | Path) -> tuple[str, DataFrame]:
    """(format, rows) by detection."""
    kind = detect(path)
    return kind, READERS[kind](spark, path)

"""Typed rows from raw BED5 lines, with a reason for every line that fails.

Blocks of lines are parsed in bulk by Arrow kernels that either take a whole block or refuse it.  The checks of a refused
block leave a mask, and the block is cut in two again and again where the mask shows failures, down to single lines:
halves without any are taken in bulk, the failing lines go one by one through a strict parser that names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASONS = ("bad_quoting", "too_few_columns", "bad_start", "bad_end", "bad_range", "bad_score")
LARGEST = 4294967295
#: Lines of a block.  Lines that pass every mask and are refused even so (numbers that a kernel can't convert) are bisected by
#: bulk calls, which have a fixed cost of about 90 strictly read lines, down to ``LEAF``.
BLOCK, LEAF = 4096, 64

COLUMN = r'"(?:[^"]|"")*"|[^"\t][^\t]*|'
RECORD = "^" + r"\t".join(f"(?P<c{i}>{COLUMN})" for i in range(5)) + rf"(?:\t(?:{COLUMN}))*$"
DIGITS = r"^[0-9]+$"
SCORE = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"

_DIGITS, _SCORE = re.compile(r"[0-9]+"), re.compile(SCORE[1:-1])
OUT = pa.schema([("seqname", pa.string()), ("range_start", pa.int64()), ("range_end", pa.int64()), ("feature_name", pa.string()), ("score", pa.float64()), ("reason", pa.string())])


class Refused(Exception):
    """A block that the bulk path does not take as a whole."""


def _all(mask) -> None:
    if not pc.all(mask, min_count=0).as_py():
        raise Refused


def _plain(col: pa.Array) -> pa.Array:
    """Quotes taken off."""
    quoted = pc.starts_with(col, '"')
    if not pc.any(quoted, min_count=0).as_py():
        return col
    return pc.if_else(quoted, pc.replace_substring(pc.utf8_slice_codeunits(col, 1, -1), '""', '"'), col)


def _position(col: pa.Array) -> pa.Array:
    _all(pc.match_substring_regex(col, DIGITS))
    short = pc.replace_substring_regex(col, "^0+([0-9])", r"\1")
    _all(pc.less_equal(pc.utf8_length(short), 10))
    value = pc.cast(short, pa.int64())
    _all(pc.less_equal(value, LARGEST))
    return value


def parse_bulk(lines: pa.Array) -> list[pa.Array]:
    """The five typed columns of a block of valid lines; Refused if one of them is not."""
    cols = pc.extract_regex(lines, RECORD)
    if cols.null_count:
        raise Refused
    name, start, end, feature, score = (_plain(c) for c in cols.flatten())
    start, end = _position(start), _position(end)
    _all(pc.greater(end, start))
    missing = pc.equal(score, ".")
    _all(pc.or_(missing, pc.match_substring_regex(score, SCORE)))
    try:
        score = pc.cast(pc.replace_substring_regex(pc.if_else(missing, pa.scalar(None, pa.string()), score), r"^\+", ""), pa.float64())
    except pa.ArrowInvalid as e:
        raise Refused from e
    return [name, start, end, feature, score]


def passing(lines: pa.Array) -> pa.Array:
    """For each line whether it passes every check of the bulk path: one mask a check, none of them refuses the block."""
    cols = pc.extract_regex(lines, RECORD)
    ok = pc.is_valid(cols)
    # columns of the struct without its own nulls: give lines that are no record an empty text, which fails the digits
    _, start, end, _, score = (_plain(pc.if_else(ok, pc.struct_field(cols, i), "")) for i in range(5))
    at = []
    for col in (start, end):
        short = pc.replace_substring_regex(col, "^0+([0-9])", r"\1")
        ok = pc.and_(ok, pc.and_(pc.match_substring_regex(col, DIGITS), pc.less_equal(pc.utf8_length(short), 10)))
        at.append((short, pc.match_substring_regex(short, r"^[0-9]{1,10}$")))
    start, end = (pc.cast(pc.if_else(fits, short, "0"), pa.int64()) for short, fits in at)
    ok = pc.and_(ok, pc.and_(pc.less_equal(start, LARGEST), pc.and_(pc.less_equal(end, LARGEST), pc.greater(end, start))))
    return pc.and_(ok, pc.or_(pc.equal(score, "."), pc.match_substring_regex(score, SCORE)))


def split_strictly(line: str) -> list[str] | None:
    """Columns of a line without their quotes; None if a quoted column is not closed before a tab or the end."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            value, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                value.append(line[i:j])
                if line[j + 1 : j + 2] != '"':
                    i = j + 1
                    break
                value.append('"')
                i = j + 2
            if i < n and line[i] != "\t":
                return None
            out.append("".join(value))
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


def parse_strictly(line: str) -> tuple:
    """(seqname, start, end, name, score, reason) of one line; the values are None where a reason is given."""

    def fail(reason):
        return (None, None, None, None, None, reason)

    cols = split_strictly(line)
    if cols is None:
        return fail("bad_quoting")
    if len(cols) < 5:
        return fail("too_few_columns")
    at = []
    for text, reason in ((cols[1], "bad_start"), (cols[2], "bad_end")):
        digits = text.lstrip("0") or "0"
        if not _DIGITS.fullmatch(text) or len(digits) > 10 or int(digits) > LARGEST:
            return fail(reason)
        at.append(int(digits))
    if at[1] <= at[0]:
        return fail("bad_range")
    if cols[4] != "." and not _SCORE.fullmatch(cols[4]):
        return fail("bad_score")
    return (cols[0], *at, cols[3], None if cols[4] == "." else float(cols[4]), None)


def parse_lines(lines: pa.Array, block: int = BLOCK, leaf: int = LEAF) -> pa.Table:
    """Parse lines that are records (no comments, no blanks); row i of the result is line i."""

    def strictly(part: pa.Array) -> pa.Table:
        rows = [parse_strictly(x) for x in part.to_pylist()]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT) if rows else OUT.empty_table()

    def in_bulk(part: pa.Array) -> pa.Table:
        cols = parse_bulk(part)
        return pa.table([pa.array(c) if isinstance(c, list) else c for c in cols] + [pa.nulls(len(part), pa.string())], schema=OUT)

    def bisected(part: pa.Array) -> list[pa.Table]:
        try:
            return [in_bulk(part)]
        except Refused:
            half = len(part) // 2
            return [strictly(part)] if len(part) <= leaf else bisected(part.slice(0, half)) + bisected(part.slice(half))

    def isolated(upto: np.ndarray, lo: int, hi: int) -> list[int]:
        """The failing lines of lo..hi by bisection; upto[i] is how many of the first i lines fail."""
        n = int(upto[hi] - upto[lo])
        if n in (0, hi - lo):
            return list(range(lo, hi)) if n else []
        mid = (lo + hi) // 2
        return isolated(upto, lo, mid) + isolated(upto, mid, hi)

    def one(part: pa.Array) -> list[pa.Table]:
        try:
            return [in_bulk(part)]
        except Refused:
            ok = passing(part).to_numpy(zero_copy_only=False).astype(bool)
        bad = np.array(isolated(np.concatenate([[0], np.cumsum(~ok)]), 0, len(part)), np.int64)
        good = np.delete(np.arange(len(part)), bad)
        if not len(bad):
            return bisected(part)
        both = pa.concat_tables([*(bisected(part.take(pa.array(good))) if len(good) else []), strictly(part.take(pa.array(bad)))])
        return [both.take(pa.array(np.argsort(np.concatenate([good, bad]))))]

    pieces = [t for i in range(0, len(lines), block) for t in one(lines.slice(i, block))]
    return pa.concat_tables(pieces) if pieces else OUT.empty_table()


def parse_bed5(df: DataFrame, line: str = "line", keep: Sequence[str] | None = None, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """One row per record: the columns ``keep`` (all but the line unless given), the typed BED5 columns and ``reason``.

    reason is null for a valid line, else the typed columns are null.  One carriage return at the end is dropped;
    lines that are then empty, begin with # or are null are no records and give no row.  Kept columns that have the
    name of a typed one get the prefix raw_.  Narrow: no shuffle, memory of one Arrow batch.
    """
    keep = [c for c in df.columns if c != line] if keep is None else list(keep)
    named = [F.col(c).alias("raw_" + c if c in OUT.names else c) for c in keep]
    src = df.select(*named, F.col(line).alias("_line"))
    typed = [T.StructField(n, t) for n, t in zip(OUT.names, (T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), T.StringType()))]
    schema = T.StructType([f for f in src.schema.fields if f.name != "_line"] + typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.cast(batch.column(batch.num_columns - 1), pa.string())
            lines = pc.replace_substring_regex(lines, r"\r\z", "")
            record = pc.fill_null(pc.and_(pc.greater(pc.utf8_length(lines), 0), pc.invert(pc.starts_with(lines, "#"))), False)
            at = pa.array(np.flatnonzero(record.to_numpy(zero_copy_only=False)))
            if not len(at):
                continue
            table = parse_lines(lines.take(at), block, leaf)
            kept = [batch.column(i).take(at) for i in range(batch.num_columns - 1)]
            out = pa.table(kept + table.columns, names=batch.schema.names[:-1] + OUT.names)
            yield from out.combine_chunks().to_batches()

    return src.mapInArrow(run, schema)


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).drop(*[n for n in OUT.names if n != "reason"])

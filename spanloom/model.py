"""RangeFrame: a DataFrame of ranges with its genome, and the names of the standard columns."""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import MissingSequenceError, NoRowsError, RangeOutOfBoundsError
from .functions import arith

SEQ, START, END, LENGTH, ORD = "seqname", "range_start", "range_end", "seq_length", "ord"
KEYS = [SEQ, START, END]

EMPTY_SCHEMA = T.StructType([T.StructField(SEQ, T.StringType()), T.StructField(START, T.LongType()), T.StructField(END, T.LongType())])
SEQLENS_SCHEMA = T.StructType([T.StructField(SEQ, T.StringType()), T.StructField(LENGTH, T.LongType()), T.StructField(ORD, T.IntegerType())])

#: Rows up to which a genome table is broadcast; a longer one is joined by shuffle.
GENOME_BROADCAST_ROWS = 200_000


_KNOWN: OrderedDict[tuple, object] = OrderedDict()


def identity(df: DataFrame) -> tuple | None:
    """What a table is as long as its plan and the files it reads, with their sizes and times, stay the same; None if it
    reads anything but files on a disk that the driver sees."""
    files, leaves = [], df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    while leaves.hasNext():
        if not leaves.next().nodeName().startswith("LogicalRelation"):
            return None
    for f in df.inputFiles():
        place = f.removeprefix("file://")
        if len(files) == 1000 or not os.path.isfile(place):
            return None
        files.append((f, os.path.getsize(place), os.path.getmtime(place)))
    return df.sparkSession.sparkContext.applicationId, df.semanticHash(), *files


def known(key: tuple | None, what: Callable[[], object]) -> object:
    """A small fact about tables, such as a count, kept under their identity; found anew where that is None."""
    if key is None:
        return what()
    if key not in _KNOWN:
        _KNOWN[key] = what()
        while len(_KNOWN) > 256:
            _KNOWN.popitem(last=False)
    return _KNOWN[key]


def proved_small(df: DataFrame, rows: int = GENOME_BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``rows`` rows, which a limited count proves.  The proof is kept, so that a genome is
    counted once and not by every operator that looks something up in it."""
    key = identity(df)
    return known(key and ("rows", rows, key), lambda: df.limit(rows + 1).count() <= rows)


def lookup_join(fact: DataFrame, dim: DataFrame, fact_keys: Sequence[str], dim_keys: Sequence[str], how: str = "left", spread_by: str | None = None, rows: int = GENOME_BROADCAST_ROWS, salts: int = 16, null_safe: bool = False) -> DataFrame:
    """Join with a table that has few rows per key, whatever share of the fact rows one key holds.

    A dim of at most ``rows`` rows, which a limited count proves, is broadcast.  A longer one is joined by shuffle, with
    every key spread over ``salts`` parts: fact rows by the hash of ``spread_by``, the dim copied to all parts; adaptive
    execution splits parts that are still too large.  ``null_safe``: null keys meet null keys.
    """
    same = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    on = [same(fact[a], dim[b]) for a, b in zip(fact_keys, dim_keys)]
    if rows >= 0 and proved_small(dim, rows):
        return fact.join(F.broadcast(dim), on, how)
    if spread_by is None:
        return fact.join(dim, on, how)
    salted = fact.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    parts = dim.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = [same(salted[a], parts[b]) for a, b in zip(fact_keys, dim_keys)] + [salted["__salt"] == parts["__part"]]
    return salted.join(parts, on, how).drop("__salt", "__part")


class RangeFrame:
    """Ranges plus genome.

    ``df`` needs the columns seqname, range_start, range_end; all others are payload that travels with its row.
    ``seqlens`` has seqname, seq_length and ord, one row per sequence.  Operators never change either in place.
    Rows whose seqname, start or end is null take part in no overlap and are kept only by operators that keep
    unmatched rows (anti-join, left join, map_data).
    """

    def __init__(self, df: DataFrame, seqlens: DataFrame):
        self.df, self.seqlens = df, seqlens

    # ---- building -------------------------------------------------------------------------------------------
    @staticmethod
    def seqlens_from(spark: SparkSession, lengths: dict[str, int] | Iterable[tuple[str, int]]) -> DataFrame:
        pairs = list(lengths.items() if isinstance(lengths, dict) else lengths)
        return spark.createDataFrame([(n, int(x), i) for i, (n, x) in enumerate(pairs)], SEQLENS_SCHEMA)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[tuple], lengths: dict[str, int], payload: str = "", check: bool = True) -> RangeFrame:
        """From literal rows (seqname, start, end, *payload); ``payload`` is a DDL list such as "score double"."""
        ddl = f"{SEQ} string, {START} long, {END} long" + (f", {payload}" if payload else "")
        rf = cls(spark.createDataFrame([tuple(r) for r in rows], ddl), cls.seqlens_from(spark, lengths))
        return rf.checked() if check else rf

    @classmethod
    def from_windows(cls, seqlens: DataFrame, width: int, step: int | None = None, chop: bool = False, keep_exact_last: bool = False) -> RangeFrame:
        """Tiling or sliding windows of every sequence.

        A window that would pass the end is cut there; with ``chop`` every window that reaches or passes the end is
        left out, also the one that fits exactly, unless ``keep_exact_last``.  step defaults to width and must be >= 1.
        """
        step = width if step is None else step
        if step < 1 or width < 1:
            raise ValueError("width and step must be at least 1")
        out = seqlens.where(F.col(LENGTH) > 0).select(SEQ, LENGTH, F.explode(arith.window_starts(LENGTH, step)).alias(START))
        full = F.col(START) + F.lit(width)
        if chop:
            out = out.where(full <= F.col(LENGTH) if keep_exact_last else full < F.col(LENGTH))
        return cls(out.select(SEQ, START, F.least(full, F.col(LENGTH)).alias(END)), seqlens)

    def checked(self, invalid: str = "raise", missing: str = "raise") -> RangeFrame:
        """Deal with empty or inverted ranges and unknown names: "raise" while the plan runs, or "drop"."""
        df = self.df
        if invalid == "drop":
            df = df.where(arith.valid_range(START, END))
        else:
            df = df.withColumn(END, F.when(arith.valid_range(START, END), F.col(END)).otherwise(F.raise_error(F.concat(F.lit("invalid range on "), F.coalesce(F.col(SEQ), F.lit("null")))).cast("long")))
        names = self.seqlens.select(F.col(SEQ).alias("__known")).distinct()
        if missing == "drop":
            df = lookup_join(df, names, [SEQ], ["__known"], "left_semi", START)
        else:
            df = lookup_join(df, names, [SEQ], ["__known"], "left", START)
            df = df.withColumn(SEQ, F.when(F.col("__known").isNotNull(), F.col(SEQ)).otherwise(F.raise_error(F.concat(F.lit("unknown sequence "), F.coalesce(F.col(SEQ), F.lit("null")))).cast("string"))).drop("__known")
        return RangeFrame(df, self.seqlens)

    def validated(self) -> RangeFrame:
        """Opt-in: raise at run time for ranges that do not fit their sequence (start < end <= length)."""
        df = self.with_lengths()
        ok = arith.slice_ok(START, END, "__len")
        df = df.withColumn(END, F.when(ok, F.col(END)).otherwise(F.raise_error(F.lit(RangeOutOfBoundsError.__doc__)).cast("long")))
        return RangeFrame(df.drop("__len"), self.seqlens)

    def require_names(self) -> RangeFrame:
        """Eager check: MissingSequenceError names up to five sequences that the genome does not hold."""
        bad = self.df.where(F.col(SEQ).isNotNull()).join(self.seqlens, SEQ, "left_anti").select(SEQ).distinct().limit(5).collect()
        if bad:
            raise MissingSequenceError(", ".join(r[0] for r in bad))
        return self

    def require_rows(self) -> RangeFrame:
        """Eager check: NoRowsError if there are none."""
        if self.df.isEmpty():
            raise NoRowsError("the input has no rows")
        return self

    def with_lengths(self, name: str = "__len") -> DataFrame:
        """The rows whose name is known, with the length of their sequence."""
        dim = self.seqlens.select(F.col(SEQ).alias("__k"), F.col(LENGTH).alias(name))
        return lookup_join(self.df, dim, [SEQ], ["__k"], "inner", START).drop("__k")

    def _on(self, df: DataFrame) -> RangeFrame:
        return RangeFrame(df, self.seqlens)

    # ---- projections and filters ----------------------------------------------------------------------------
    @property
    def payload(self) -> list[str]:
        return [c for c in self.df.columns if c not in KEYS]

    def retain_seqnames(self, names: Sequence[str]) -> RangeFrame:
        return self._on(self.df.where(F.col(SEQ).isin(list(names))))

    def exclude_seqnames(self, names: Sequence[str]) -> RangeFrame:
        """Drop the named sequences; rows without a name stay."""
        return self._on(self.df.where(~F.coalesce(F.col(SEQ).isin(list(names)), F.lit(False))))

    def filter_chroms(self) -> RangeFrame:
        """Rows whose name is in the genome, payload kept."""
        return self._on(lookup_join(self.df, self.seqlens.select(F.col(SEQ).alias("__k")).distinct(), [SEQ], ["__k"], "left_semi", START))

    def map_data(self, **columns: Column) -> RangeFrame:
        """Replace the payload by the given expressions."""
        return self._on(self.df.select(*KEYS, *[c.alias(n) for n, c in columns.items()]))

    def unwrap_data(self, column: str) -> RangeFrame:
        """Raise at run time where a payload value is missing."""
        value = F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit(f"missing {column}")).cast(self.df.schema[column].dataType))
        return self._on(self.df.withColumn(column, value))

    def into_empty(self) -> RangeFrame:
        return self._on(self.df.select(*KEYS))

    def into_data(self, values: DataFrame, order: Sequence[str], value_order: Sequence[str]) -> RangeFrame:
        """Pair ranges with the rows of another table by position under the two orders; counts must agree.

        Positions come from a range sort and per-partition offsets, not from one global window.
        """
        from .operators.ordering import with_position

        left, right = with_position(self.df.select(*KEYS), order, "__pos"), with_position(values, value_order, "__pos")
        if left.count() != right.count():
            raise ValueError("the numbers of ranges and values differ")
        return self._on(left.join(right, "__pos").drop("__pos"))

    # ---- arithmetic -----------------------------------------------------------------------------------------
    def adjust_ranges(self, start_delta: int, end_delta: int) -> RangeFrame:
        """Move both bounds, clamp to the sequence and drop what becomes empty."""
        lo, hi = arith.adjusted(START, END, start_delta, end_delta, "__len")
        df = self.with_lengths().withColumns({"__lo": lo, "__hi": hi}).where("__hi > __lo")
        return self._on(df.withColumns({START: F.col("__lo"), END: F.col("__hi")}).drop("__lo", "__hi", "__len"))

    def flanking_ranges(self, left: int | None = None, right: int | None = None, side_column: str | None = None) -> RangeFrame:
        """Non-empty left and right flanks with the payload of their range."""
        df = self.with_lengths().withColumn("__f", F.explode(arith.flanks(START, END, left, right, "__len")))
        cols = {START: F.col("__f.start"), END: F.col("__f.end")} | ({side_column: F.col("__f.side")} if side_column else {})
        return self._on(df.withColumns(cols).drop("__f", "__len"))

    def midpoints(self) -> DataFrame:
        return self.df.select(SEQ, arith.midpoint(START, END).alias("midpoint"))

    def widths(self) -> DataFrame:
        return self.df.select(*KEYS, arith.width(START, END).alias("width"))

    def coverage(self) -> DataFrame:
        """One row: the sum of all widths, overlaps counted as often as they occur; 0 for no rows."""
        return self.df.agg(F.coalesce(F.sum(arith.width(START, END)), F.lit(0)).cast("long").alias("coverage"))

    # ---- joins, merges --------------------------------------------------------------------------------------
    def left_overlaps(self, right: RangeFrame, **kw) -> DataFrame:
        from .operators.join import left_grouped

        return left_grouped(self.df, right.df, **kw)

    def map_joins(self, right: RangeFrame, aggregates: Sequence[Column], **kw) -> DataFrame:
        from .operators.join import map_overlaps

        return map_overlaps(self.df, right.df, aggregates, **kw)

    def filter_overlaps(self, right: RangeFrame, **kw) -> RangeFrame:
        from .operators.join import semi

        return self._on(semi(self.df, right.df, **kw))

    def antifilter_overlaps(self, right: RangeFrame, **kw) -> RangeFrame:
        from .operators.join import anti

        return self._on(anti(self.df, right.df, **kw))

    def merge(self, distance: int = 0, aggregates: Sequence[Column] = (), **kw) -> RangeFrame:
        from .operators.merge import merge

        return self._on(merge(self.df, distance, aggregates, **kw))

    # ---- order and access -----------------------------------------------------------------------------------
    def sort(self) -> RangeFrame:
        """Order by genome order, then start and end; names outside the genome follow in natural order."""
        from .operators.ordering import sort_ranges

        return self._on(sort_ranges(self.df, self.seqlens))

    def get_ranges(self, name: str) -> DataFrame:
        return self.df.where(F.col(SEQ) == name)

    def seqnames(self) -> list[str]:
        return [r[0] for r in self.seqlens.orderBy(ORD).select(SEQ).collect()]

    def data_by_seqname(self, column: str) -> DataFrame:
        """One row per sequence with its payload values in range order."""
        rows = F.array_sort(F.collect_list(F.struct(START, END, column)))
        return self.df.groupBy(SEQ).agg(F.transform(rows, lambda r: r[column]).alias(column))

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def iter_records(self):
        """Rows in range order, streamed partition by partition."""
        return self.sort().df.toLocalIterator()

    def equals(self, other: RangeFrame) -> bool:
        """The same rows as often; genomes are not compared."""
        if sorted(self.df.columns) != sorted(other.df.columns):
            return False
        a, b = self.df, other.df.select(*self.df.columns)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def pipe(self, f: Callable[[DataFrame], DataFrame]) -> RangeFrame:
        return self._on(f(self.df))

"""Overlap joins as equi-joins on bins.

Both sides are spread over the bins they touch and meet on (seqname, level, bin); a pair counts only in the bin of
its intersection's start, so no pair repeats and nothing is made distinct.  Wide ranges live on coarser levels, so a
range touches at most ``MAX_BINS`` bins of its own level.  Nothing but Spark's own size checks decides on broadcasts,
and the equi-join lets adaptive execution split hot bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import agg as A
from ..functions.arith import overlap_width, valid_range, window_ids
from ..model import END, LENGTH, SEQ, START, RangeFrame, identity, known, lookup_join

#: Bins that a range may touch on one level before it moves to a coarser one, and the growth of bins from level to level.
MAX_BINS, GROWTH = 16, 64


def choose_bin(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """(bin width, number of levels) from the widths of both sides: one small aggregate of two numbers, which is kept for
    as long as both tables stay what they are."""
    keys = identity(left.select(START, END)), identity(right.select(START, END))
    return known(("bin", *keys) if all(keys) else None, lambda: _choose_bin(left, right))


def _choose_bin(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    w = left.select((F.col(END) - F.col(START)).alias("w")).unionAll(right.select((F.col(END) - F.col(START)).alias("w"))).where("w > 0")
    typical, most = w.agg(F.percentile_approx("w", 0.9, 200), F.max("w")).first()
    b = max(64, int(typical or 64))
    return b, levels_for(b, int(most or 1))


def levels_for(bin_size: int, most: int) -> int:
    n, b = 1, bin_size
    while most > MAX_BINS * b:
        n, b = n + 1, b * GROWTH
    return n


def _own_level(bin_size: int, levels: int) -> Column:
    w, out = F.col("__e") - F.col("__s"), F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        out = F.when(w <= F.lit(MAX_BINS * bin_size * GROWTH**k), F.lit(k)).otherwise(out)
    return out


def _bins(df: DataFrame, bin_size: int, levels: int, left: bool) -> DataFrame:
    """Rows spread over the keys (__lv, __bin) where they meet the other side; __b is the bin width there.

    A pair meets on the coarser of its two levels.  On each level there are three kinds of meeting, and a row takes part in
    those where it belongs: 0, both live there; 1, only the left row does; 2, only the right row.
    """
    if levels == 1:
        rows = df.withColumns({"__lv": F.lit(0), "__b": F.lit(bin_size).cast("long")})
    else:
        df = df.withColumn("__own", _own_level(bin_size, levels))
        keys = [F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(bin_size * GROWTH**k).cast("long").alias("b")) for k in range(levels) for kind in range(3)]
        here, below = (1, 2) if left else (2, 1)
        rows = df.withColumn("__k", F.explode(F.array(*keys)))
        lives = (F.col("__own") == F.col("__k.k")) & F.col("__k.kind").isin(0, here)
        rows = rows.where(lives | (F.col("__own") < F.col("__k.k")) & (F.col("__k.kind") == below))
        rows = rows.withColumns({"__lv": F.col("__k.k") * 3 + F.col("__k.kind"), "__b": F.col("__k.b")}).drop("__k", "__own")
    first, last = (F.floor(x / F.col("__b")).cast("long") for x in (F.col("__s"), F.col("__e") - 1))
    return rows.withColumn("__bin", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, bin_size: int | None = None, levels: int | None = None, right_prefix: str = "r_", exists: bool = False) -> DataFrame:
    """Flat inner overlap join: every pair once, left columns as they are, right ones with ``right_prefix``.

    With ``exists`` no pairs are formed: the left rows that overlap something, once per bin in which they do.

    Strict half-open overlap on equal seqname.  Rows with null or empty ranges or a null name pair with nothing.
    A caller who gives ``bin_size`` also bounds the levels (1 unless given): then no statistics are read.
    Left columns whose names begin like renamed right ones keep their values, as the right side is renamed first.
    """
    if bin_size is None:
        bin_size, found = choose_bin(left, right)
        levels = levels or found
    levels = levels or 1
    if taken := {right_prefix + c for c in right.columns} & set(left.columns):
        raise ValueError(f"choose another right_prefix: {sorted(taken)}")
    ls = left.where(valid_range(START, END) & F.col(SEQ).isNotNull()).withColumns({"__s": F.col(START).cast("long"), "__e": F.col(END).cast("long")})
    rs = right.where(valid_range(START, END) & F.col(SEQ).isNotNull())
    rs = rs.select(*[F.col(c).alias(right_prefix + c) for c in right.columns], F.col(SEQ).alias("__rq"), F.col(START).cast("long").alias("__s"), F.col(END).cast("long").alias("__e"))
    keep = left.columns if exists else [*left.columns, *[right_prefix + c for c in right.columns]]
    lb = _bins(ls, bin_size, levels, True)
    rb = _bins(rs, bin_size, levels, False).drop("__b").withColumnsRenamed({"__s": "__rs", "__e": "__re", "__bin": "__rbin", "__lv": "__rlv"})
    on = (lb[SEQ] == rb["__rq"]) & (lb["__lv"] == rb["__rlv"]) & (lb["__bin"] == rb["__rbin"]) & (lb["__s"] < rb["__re"]) & (rb["__rs"] < lb["__e"])
    if exists:
        return lb.join(rb, on, "left_semi").select(*keep)
    on &= F.floor(F.greatest(lb["__s"], rb["__rs"]) / lb["__b"]) == lb["__bin"]
    return lb.join(rb, on).select(*keep)


def _geometry_join(left: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join back on (seqname, start, end): results that depend on the geometry alone need no row id."""
    t = table.withColumnsRenamed({SEQ: "__gq", START: "__gs", END: "__ge"})
    on = (left[SEQ] == t["__gq"]) & (left[START] == t["__gs"]) & (left[END] == t["__ge"])
    out = left.join(t, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop("__gq", "__gs", "__ge")


def map_overlaps(left: DataFrame, right: DataFrame, aggregates: Sequence[Column], fill: dict | None = None, distinct: bool = False, **kw) -> DataFrame:
    """One row per left row with aggregates over its overlapping right rows (left outer grouped join).

    ``aggregates`` refer to right columns by their prefixed names and to the left geometry.  Groups are formed per
    distinct geometry, with partial aggregation before the shuffle.  Left rows without a match get null, or the
    values of ``fill``.  ``distinct`` says that no left geometry repeats, as with windows, and saves a shuffle.
    """
    shape = left.select(SEQ, START, END)
    shape = shape if distinct else shape.distinct()
    out = overlap_pairs(shape, right, **kw).groupBy(SEQ, START, END).agg(*aggregates)
    return fill_null(_geometry_join(left, out, "left"), fill or {})


def fill_null(df: DataFrame, values: dict) -> DataFrame:
    """Replace nulls, and only nulls: DataFrame.fillna would replace NaN as well."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in values.items()}) if values else df


def map_scores(left: DataFrame, right: DataFrame, operations: Sequence[str], score: str = "score", order: Sequence[str] = (), **kw) -> DataFrame:
    """The map command: score operations of the overlapping right rows; null scores are left out first.

    Left rows without scores get sum 0, collapse "" and null for the rest.
    """
    x = F.col("r_" + score).cast("double")
    by = [F.col(f"r_{START}"), F.col(f"r_{END}"), *[F.col("r_" + c) for c in order]]
    cols = list(dict.fromkeys([SEQ, START, END, score, *order]))
    out = map_overlaps(left, right.where(F.col(score).isNotNull()).select(*cols), A.operations(operations, x, by), **kw)
    fill = {f"score_{n}": v for n, v in (("sum", 0.0), ("collapse", "")) if n in operations}
    return fill_null(out, fill)


def map_windows(right: DataFrame, seqlens: DataFrame, width: int, operations: Sequence[str], step: int | None = None, chop: bool = False, score: str = "score", order: Sequence[str] = ()) -> DataFrame:
    """map_scores over all regular windows of the genome.  The windows that a range overlaps follow from its
    coordinates and the length of the sequence, so the ranges are not joined with the windows, only their aggregates."""
    step, x = step or width, F.col(score).cast("double")
    dim = seqlens.select(F.col(SEQ).alias("__k"), F.col(LENGTH).alias("__len"))
    rows = right.where(F.col(score).isNotNull() & valid_range(START, END)).select(SEQ, START, END, score, *order)
    rows = lookup_join(rows, dim, [SEQ], ["__k"], "inner", START).where(F.col(START) < F.col("__len"))
    rows = rows.withColumn("__w", F.explode(window_ids(START, F.least(END, "__len"), width, step)))
    got = rows.groupBy(SEQ, (F.col("__w") * step).alias("__lo")).agg(*A.operations(operations, x, [F.col(START), F.col(END), *map(F.col, order)]))
    windows = RangeFrame.from_windows(seqlens, width, step, chop).df
    out = windows.join(got.withColumnRenamed(SEQ, "__gq"), (F.col(SEQ) == F.col("__gq")) & (F.col(START) == F.col("__lo")), "left").drop("__gq", "__lo")
    return fill_null(out, {f"score_{n}": v for n, v in (("sum", 0.0), ("collapse", "")) if n in operations})


def left_grouped(left: DataFrame, right: DataFrame, name: str = "overlaps", **kw) -> DataFrame:
    """One row per left row with the array of its overlapping right rows, sorted by start, end and the other columns.

    The array of a left row holds what overlaps it, however much; for aggregates use map_overlaps, which never
    builds arrays.  Left rows without a match get an empty array.
    """
    fields = [F.col(f"r_{START}").alias(START), F.col(f"r_{END}").alias(END), *[F.col("r_" + c).alias(c) for c in right.columns if c not in (SEQ, START, END)]]
    out = map_overlaps(left, right, [F.array_sort(F.collect_list(F.struct(*fields))).alias(name)], **kw)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)))


def count_overlaps(left: DataFrame, right: DataFrame, name: str = "n_overlaps", **kw) -> DataFrame:
    """One row per left row with the number of overlapping right rows."""
    return map_overlaps(left, right.select(SEQ, START, END), [F.count(F.lit(1)).alias(name)], fill={name: 0}, **kw)


def overlap_stats(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    """Per left row: number of overlaps, the sum of their widths and the largest one."""
    w = overlap_width(START, END, f"r_{START}", f"r_{END}")
    aggs = [F.count(F.lit(1)).alias("n_overlaps"), F.sum(w).alias("overlap_sum"), F.max(w).alias("overlap_max")]
    return map_overlaps(left, right.select(SEQ, START, END), aggs, fill={"n_overlaps": 0, "overlap_sum": 0, "overlap_max": 0}, **kw)


def _matched(left: DataFrame, right: DataFrame, bin_size: int | None, levels: int | None) -> DataFrame:
    """Distinct left geometries that overlap something."""
    return overlap_pairs(left.select(SEQ, START, END), right.select(SEQ, START, END), bin_size, levels, exists=True).distinct()


def semi(left: DataFrame, right: DataFrame, bin_size: int | None = None, levels: int | None = None) -> DataFrame:
    """Left rows that overlap some right row, as often as they occur."""
    return _geometry_join(left, _matched(left, right, bin_size, levels), "left_semi")


def anti(left: DataFrame, right: DataFrame, bin_size: int | None = None, levels: int | None = None) -> DataFrame:
    """Left rows that overlap no right row; rows with null bounds or names overlap nothing and are kept."""
    return _geometry_join(left, _matched(left, right, bin_size, levels), "left_anti")


def weighted_mean_overlaps(left: DataFrame, right: DataFrame, score: str = "score", name: str = "weighted_mean", **kw) -> DataFrame:
    """Per left row the mean score weighted by overlap width; 0.0 where nothing overlaps."""
    w = overlap_width(START, END, f"r_{START}", f"r_{END}").cast("double")
    out = map_overlaps(left, right.where(F.col(score).isNotNull()).select(SEQ, START, END, score), [A.weighted_mean(F.col("r_" + score).cast("double"), w).alias(name)], **kw)
    return fill_null(out, {name: 0.0})

"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Each input is reduced to one compact state per join key before anything is joined; Spark's partial aggregation makes
the state within each map task, so a key with a third of all rows sends one row per task through the shuffle.  States
are joined, counts multiplied and sums scaled by the other side's count, and the products rolled up.  The result
equals grouping the joined rows, which are never formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.agg import finite
from ..functions.arith import valid_range
from ..model import END, SEQ, START
from .periods import covered_width

#: Type of counts of joined pairs: a product of two long counts may exceed a long.
WIDE = "decimal(38,0)"


def key_state(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column] | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """(keys, n, sums..., extra...): one row per key, null keys included as a key of their own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in (sums or {}).items()], *extra)


def eager_join_aggregate(left: DataFrame, right: DataFrame, on: Sequence[str], left_sums: Mapping[str, Column] | None = None, right_sums: Mapping[str, Column] | None = None, products: Mapping[str, tuple[str, str]] | None = None, rollup: Sequence[str] | None = None, left_by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over the inner equi-join of two tables, without the join.

    n_left and n_right count the rows of either side whose key occurs on both, n_pairs the joined rows; each left
    (right) sum runs over the joined rows; ``products`` sum left x right terms over them.  ``rollup`` is a subset
    of ``on`` and ``left_by``, further columns that split the left states, to group by (all of them unless given, [] for
    one total).  Null keys join with nothing.
    """
    left_sums, right_sums, rollup = dict(left_sums or {}), dict(right_sums or {}), list([*on, *left_by] if rollup is None else rollup)
    ls = key_state(left, [*on, *left_by], left_sums).withColumnsRenamed({"n": "_ln"} | {k: "_l" + k for k in left_sums})
    rs = key_state(right, on, right_sums).withColumnsRenamed({"n": "_rn"} | {k: "_r" + k for k in right_sums})
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    j = ls.join(rs, list(on))
    out = [F.sum("_ln").alias("n_left"), F.sum("_rn").alias("n_right"), F.sum(wide("_ln") * wide("_rn")).cast(WIDE).alias("n_pairs")]
    out += [F.sum(F.col("_l" + k) * F.col("_rn")).alias(k) for k in left_sums]
    out += [F.sum(F.col("_r" + k) * F.col("_ln")).alias(k) for k in right_sums]
    out += [F.sum(F.col("_l" + a) * F.col("_r" + b)).alias(k) for k, (a, b) in (products or {}).items()]
    return j.groupBy(*rollup).agg(*out)


def range_state(df: DataFrame, keys: Sequence[str] = (SEQ,), score: str | None = None) -> DataFrame:
    """Counts, widths and score statistics per key.

    total_width sums valid ranges, overlaps counted as often as they occur; the score columns are over finite
    scores, with nulls and non-finite ones counted beside them.
    """
    sums = {"n_valid": F.when(valid_range(START, END), 1).otherwise(0), "total_width": F.when(valid_range(START, END), F.col(END) - F.col(START)).otherwise(0)}
    extra = []
    if score:
        x = F.when(finite(F.col(score)), F.col(score))
        extra = [F.count(x).alias("n_score"), F.sum(F.when(F.col(score).isNull(), 1).otherwise(0)).alias("n_null_score"), F.min(x).alias("score_min"), F.max(x).alias("score_max"), F.sum(x).alias("score_sum"), F.avg(x).alias("score_mean")]
    return key_state(df, keys, sums, extra)


def profile(df: DataFrame, keys: Sequence[str] = (SEQ,), score: str | None = None) -> DataFrame:
    """range_state with the covered width (0 where a key has no valid range); rows with a null key are left out."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return range_state(rows, keys, score).join(covered_width(rows, keys), list(keys), "left").fillna(0, ["covered_width"])


def heavy_keys(tables: Mapping[str, DataFrame], key: str, share: tuple[int, int]) -> DataFrame:
    """(table_name, key): keys that hold at least share[0]/share[1] of a table's rows with a non-null key.

    Eager aggregation of the join of all rows with all rows of their table: a key with n of the table's t rows is in n * t
    joined pairs, and n * n of them is its share.  Only states of (table, key) and of tables are joined.
    """
    rows = None
    for name, df in tables.items():
        one = df.where(F.col(key).isNotNull()).select(F.lit(name).alias("table_name"), key)
        rows = one if rows is None else rows.unionAll(one)
    state = eager_join_aggregate(rows, rows.select("table_name"), ["table_name"], left_by=[key])
    num, den = share
    n, wide = F.col("n_left"), "decimal(38,0)"
    heavy = state.where((n.cast("decimal(19,0)") * n * F.lit(den)).cast(wide) >= (F.col("n_pairs") * F.lit(num)).cast(wide))
    return heavy.select("table_name", key, n.alias("n"), F.expr("CAST(n_pairs div n_left AS BIGINT)").alias("total"))

"""Percentiles from dyadic Count-sketches.

A value becomes a code of ``BITS`` bits that keeps its order: the top bits of its IEEE form, so a code stands for
values that differ by less than 2**-20 of themselves.  A code has one ancestor per level of the dyadic tree.  Level
``TOP`` is counted exactly; each finer level has a signed Count-sketch of ``ROWS`` x ``COLUMNS`` cells.  All cells are
plain sums, so partial results of files or days merge by addition and rows can be deleted by negative weights.  A rank
is inverted by going down the tree: at each node the left child's count decides which way.

A partial result is a table (keys, cell, n).  Cells >= 0 are sketch cells.  A group with at most as many distinct codes
as its sketch has cells is kept as its frequency vector, cell = -1 - code: the same linear form before hashing, smaller
and without error.  A task hashes what is larger even among its own rows; when partial results are combined, a group is
hashed as a whole if it is larger over all of them.  So the form of a group, and every answer, follows from its distinct
codes alone and not from how the job is cut into tasks (weights below zero aside, which may undo a code).

Error: for the wanted rank k of n and the returned v, at most k + RANK_ERROR * n values are below v - d and at least
k - RANK_ERROR * n are at most v + d, where d = 2**-20 |v|.  The rank is exact for groups that are not hashed.  For the
others: a node's count is wrong only if at least 4 of its 7 cells are hit by other nodes, and then by what these hold.  With
k equal values of n / k each, a cell is hit with chance k / 1024: under k = 50 the 22 levels of a descent are all right but
for a chance of 22 * 35 * (k / 1024)**4 < 0.5 %, and an error is n / k; from there on errors of a median of 7 have a
spread of at most 0.6 * n / sqrt(1024 k), 0.27 % of n at k = 50, and 22 of them add up to 1.3 % of n.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import lookup_join
from ..session import cut_lineage

RANK_ERROR = 0.02
PERCENTILES = (1, 25, 50, 75, 99)


@dataclass(frozen=True)
class Dyadic:
    """Shape of the sketch; partial results merge only if theirs is the same."""

    bits: int = 32
    top: int = 10
    rows: int = 7
    columns: int = 1024

    @property
    def levels(self) -> int:
        return self.bits - self.top

    @property
    def cells(self) -> int:
        return (1 << self.top) + self.levels * self.rows * self.columns

    # ---- codes ----------------------------------------------------------------------------------------------
    def encode(self, x: np.ndarray) -> np.ndarray:
        bits = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
        sign = np.uint64(1) << np.uint64(63)
        ordered = np.where(bits & sign, ~bits, bits | sign)
        return (ordered >> np.uint64(64 - self.bits)).astype(np.int64)

    def decode(self, code: np.ndarray) -> np.ndarray:
        """The value of a code's interval that is nearest to zero, which is exact for short decimal fractions of two."""
        code, low = np.asarray(code, np.uint64), np.uint64(64 - self.bits)
        positive = (code >> np.uint64(self.bits - 1)) & np.uint64(1)
        up = (code << low) ^ (np.uint64(1) << np.uint64(63))
        down = ~((code << low) | ((np.uint64(1) << low) - np.uint64(1)))
        return np.where(positive, up, down).view(np.float64)

    # ---- hashing --------------------------------------------------------------------------------------------
    def _place(self, node: np.ndarray, depth: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(column, sign) of nodes of one level in one row: splitmix64 of the node and the (level, row) number."""
        x = node.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + depth * self.rows + row)) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
        return (x % np.uint64(self.columns)).astype(np.int64), np.where((x >> np.uint64(40)) & np.uint64(1), 1, -1)

    def hash_codes(self, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The non-zero sketch cells of a frequency vector."""
        table = np.zeros(self.cells, np.int64)
        np.add.at(table, code >> self.levels, n)
        for d in range(self.levels):
            node = code >> (self.levels - 1 - d)
            for r in range(self.rows):
                col, sign = self._place(node, d, r)
                base = (1 << self.top) + (d * self.rows + r) * self.columns
                table[base : base + self.columns] += np.bincount(col, weights=(sign * n).astype(np.float64), minlength=self.columns).astype(np.int64)
        at = np.flatnonzero(table)
        return at, table[at]

    def invert(self, cell: np.ndarray, n: np.ndarray, percentiles: Sequence[float]) -> tuple[int, np.ndarray]:
        """(n, values at the percentiles) of one group: rank ceil(p/100 * n) and the descent to it."""
        plain = cell < 0
        code = -1 - cell[plain]
        order = np.argsort(code)
        code, cum = code[order], np.concatenate([[0], np.cumsum(n[plain][order])])
        table = np.zeros(self.cells, np.int64)
        table[cell[~plain]] = n[~plain]
        sketched = bool((~plain).any())
        top = table[: 1 << self.top].copy()
        np.add.at(top, code >> self.levels, np.diff(cum))
        total = int(top.sum())
        if total <= 0:
            return 0, np.full(len(percentiles), np.nan)
        rank = np.clip(np.ceil(np.asarray(percentiles, float) / 100 * total), 1, total)
        upto = np.cumsum(top)
        node = np.searchsorted(upto, rank)
        rest, inside = rank - (upto[node] - top[node]), top[node].astype(float)
        for d in range(self.levels):
            left, shift = node * 2, self.levels - 1 - d
            here = cum[np.searchsorted(code, (left + 1) << shift)] - cum[np.searchsorted(code, left << shift)]
            if sketched:
                guess = []
                for r in range(self.rows):
                    col, sign = self._place(left, d, r)
                    guess.append(sign * table[(1 << self.top) + (d * self.rows + r) * self.columns + col])
                here = np.clip(here + np.median(guess, axis=0), 0, inside)
            go = rest > here
            node = left + go
            rest, inside = np.where(go, rest - here, rest), np.where(go, inside - here, here)
        return total, self.decode(node)


DEFAULT = Dyadic()


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])


def _shrink(table: pa.Table, keys: list[str], shape: Dyadic, limit: int) -> pa.Table:
    """Sum equal cells; hash the groups that have more than ``limit`` plain codes."""
    table = table.group_by([*keys, "cell"], use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "cell", "n"])
    if table.num_rows <= limit:
        return table
    gid = np.zeros(table.num_rows, np.int64)
    for k in keys:
        d = table.column(k).combine_chunks().dictionary_encode()
        part = np.asarray(d.indices.fill_null(len(d.dictionary)))
        gid = np.unique(gid * (len(d.dictionary) + 1) + part, return_inverse=True)[1]
    cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
    plain = cell < 0
    large = np.flatnonzero(np.bincount(gid[plain], minlength=1) > limit)
    if not len(large):
        return table
    out = [table.filter(pa.array(~(plain & np.isin(gid, large))))]
    for g in large:
        at = np.flatnonzero(plain & (gid == g))
        c, v = shape.hash_codes(-1 - cell[at], n[at])
        first = table.slice(at[0], 1).select(keys)
        keyed = first.take(pa.array(np.zeros(len(c), np.int64)))
        out.append(keyed.append_column("cell", pa.array(c)).append_column("n", pa.array(v)))
    return pa.concat_tables(out)


def _shrinker(keys: list[str], shape: Dyadic, limit: int, encode: bool, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if encode:
                x = t.column("_x").to_numpy()
                t = t.drop_columns(["_x"]).append_column("cell", pa.array(-1 - shape.encode(x)))
                t = t.select([*keys, "cell", "n"])
            held.append(t)
            rows += t.num_rows
            if rows >= flush:
                held = [_shrink(pa.concat_tables(held), keys, shape, limit)]
                rows = held[0].num_rows
                if rows >= flush // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
        if rows:
            yield from _shrink(pa.concat_tables(held), keys, shape, limit).combine_chunks().to_batches()

    return run


def partials(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, shape: Dyadic = DEFAULT, flush: int = 1_000_000) -> DataFrame:
    """Partial results (keys, cell, n) of each map task; null, NaN and infinite values are left out.

    ``weight`` is a column of signed counts (negative to delete rows); null keys form groups of their own.  No
    shuffle; memory is bounded by ``flush`` rows.  Key columns may not be called cell, n or _x.
    """
    x = F.col(value).cast("double")
    src = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = src.select(*keys, x.alias("_x"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("n"))
    return src.mapInArrow(_shrinker(list(keys), shape, shape.cells, True, flush), _schema(df, keys))


def combine(parts: DataFrame, keys: Sequence[str], shape: Dyadic = DEFAULT, salts: int = 8, flush: int = 1_000_000) -> DataFrame:
    """Merge partial results into those of coarser keys (any subset of theirs, or expressions added as columns).

    Cells are added with partial aggregation, spread over all tasks whatever the group.  A group is large if one of its
    parts was hashed or if it has more codes than a sketch has cells; there are at most rows / cells of them.  The codes
    of a large group go to ``salts`` tasks, which hash them; the others stay as they are.
    """
    keys = list(keys)
    names = [f"_g{i}" for i in range(len(keys))]
    cells = cut_lineage(parts.groupBy(*keys, "cell").agg(F.sum("n").alias("n")).where("n <> 0"))  # used three times
    plain = F.count(F.when(F.col("cell") < 0, 1))
    large = cells.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg((F.max(F.col("cell") >= 0) | (plain > shape.cells)).alias("_large")).where("_large")
    rows = lookup_join(cells, large, keys, names, "left", "cell", null_safe=True).select(*keys, "cell", "n", F.coalesce("_large", F.lit(False)).alias("_large"))
    hashed = rows.where("_large").select(*keys, "cell", "n").repartition(*keys, F.pmod(F.xxhash64("cell"), F.lit(salts)))
    hashed = hashed.mapInArrow(_shrinker(keys, shape, 0, False, flush), _schema(parts, keys))
    return rows.where("NOT _large").select(*keys, "cell", "n").unionAll(hashed)


def percentiles(merged: DataFrame, keys: Sequence[str], points: Sequence[float] = PERCENTILES, shape: Dyadic = DEFAULT) -> DataFrame:
    """(keys, n, p1, p25, ...) from merged partial results.

    A group is at most ``salts`` sketches, or as many plain codes as one has cells, so one task can take it.  Groups whose weights
    cancel out to nothing are left out.
    """
    keys = list(keys)
    names = [f"p{p:g}".replace(".", "_") for p in points]
    schema = T.StructType([merged.schema[k] for k in keys] + [T.StructField("n", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in names])

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.groupby("cell", sort=False)["n"].sum()
        total, values = shape.invert(s.index.to_numpy(np.int64), s.to_numpy(np.int64), points)
        head = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([[*head, total, *values]], columns=[*keys, "n", *names])[: 1 if total else 0]

    return merged.groupBy(*keys).applyInPandas(invert, schema)


def group_percentiles(df: DataFrame, group: Sequence[str], value: str, part: Sequence[str] = (), points: Sequence[float] = PERCENTILES, shape: Dyadic = DEFAULT, salts: int = 8) -> DataFrame:
    """partials per (part, group), merged per group, inverted."""
    parts = partials(df, [*part, *group], value, shape=shape)
    return percentiles(combine(parts, group, shape, salts), group, points, shape)

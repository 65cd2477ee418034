"""Elementary segments of overlapping ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arith import valid_range
from ..model import END, SEQ, START, identity, known
from .islands import STRIPE, next_position, stripe_of
from .join import overlap_pairs
from .merge import merge

#: Within left ranges: positions of a stripe at least; rows taken at once, pairs of a segment with labels or left ranges
#: formed at once, and left ranges of a segment in one row.
LEAST_STRIPE, ROWS, PAIRS, LEFTS = 1 << 12, 200_000, 500_000, 4096


def _steps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and position, by how much the depth changes; summed before the shuffle."""
    ok = df.where(valid_range(START, END) & F.col(SEQ).isNotNull())
    ends = F.explode(F.array(F.struct(F.col(START).alias("p"), F.lit(1).alias("d")), F.struct(F.col(END).alias("p"), F.lit(-1).alias("d"))))
    return ok.select(*keys, ends.alias("_x")).groupBy(*keys, F.col("_x.p").alias("_p")).agg(F.sum("_x.d").cast("long").alias("_d"))


def depth(df: DataFrame, keys: Sequence[str] = (SEQ,), stripe: int = STRIPE) -> DataFrame:
    """Segments between neighbouring endpoints with the number of ranges that cover them (at least 1).

    Depth is a running sum per stripe of positions on top of the sum of all earlier stripes.
    """
    keys = list(keys)
    rows = next_position(_steps(df, keys), keys, "_p", "_q", stripe).withColumn("_stripe", stripe_of("_p", stripe))
    before = Window.partitionBy(*keys).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "_stripe").agg(F.sum("_d").alias("_t")).select(*keys, "_stripe", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*keys, "_stripe").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(base, [*keys, "_stripe"]).withColumn("depth", (F.col("_base") + F.sum("_d").over(here)).cast("long"))
    return out.where("depth > 0 AND _q IS NOT NULL").select(*keys, F.col("_p").alias(START), F.col("_q").alias(END), "depth")


def segments(df: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """Elementary segments covered by at least one range."""
    return depth(df, (SEQ,), stripe).select(SEQ, START, END)


def disjoin(df: DataFrame, label: str, name: str = "labels", bin_size: int | None = None, levels: int | None = None, stripe: int = STRIPE, merged: bool = False) -> DataFrame:
    """Elementary segments with the sorted set of the labels that cover them; null labels are left out of the set.

    The ranges of a label are merged before they meet the segments, so that a segment pairs with a label once, however
    many ranges lie there.  ``merged`` says that those of a label are apart already.
    """
    rows = df.select(SEQ, START, END, F.struct(F.col(label).alias("v")).alias("_l"))  # a null label is a label here
    whole = rows if merged else merge(rows, 0, keys=(SEQ, "_l"), stripe=stripe)
    pairs = overlap_pairs(segments(df, stripe), whole.select(SEQ, START, END, F.col("_l.v").alias("label")), bin_size, levels)
    return pairs.groupBy(SEQ, START, END).agg(F.array_sort(F.collect_set("r_label")).alias(name))


def choose_stripe(left: DataFrame, right: DataFrame) -> int:
    """A stripe of at least four mean widths of either side, so that cutting at stripes adds at most a quarter to the rows
    on average, however long single ranges are; kept for as long as both tables stay what they are."""
    keys = identity(left.select(START, END)), identity(right.select(START, END))
    return known(("stripe", *keys) if all(keys) else None, lambda: _choose_stripe(left, right))


def _choose_stripe(left: DataFrame, right: DataFrame) -> int:
    mean = [df.where(valid_range(START, END)).agg(F.avg(F.col(END) - F.col(START)).alias("w")) for df in (left, right)]
    return max(LEAST_STRIPE, *(4 * ceil(r.w or 0) for r in mean[0].unionAll(mean[1]).collect()))


def disjoin_within(left: DataFrame, right: DataFrame, label: str, name: str = "labels", stripe: int | None = None, shape: Callable[[Column], Column] | None = None) -> DataFrame:
    """(seqname, left_start, left_end, range_start, range_end, labels): for each distinct left range, the elementary
    segments of the right ranges that overlap it, cut off at its bounds.  Left ranges without overlaps give no rows.

    Inside a left range the right ranges that overlap it end and begin where all right ranges do: so the segments and their
    labels are the same for all left ranges, but for the cut.  Both sides meet once, per stripe of positions, and leave it
    as segments with their labels and left ranges; the rows come from these without a shuffle.  ``shape`` is applied to the
    labels once per segment, before the rows are made.  Memory holds one stripe.
    """
    stripe = stripe or choose_stripe(left, right)
    ok = valid_range(START, END) & F.col(SEQ).isNotNull()
    bounds = [F.col(c).cast("long").alias(c) for c in (START, END)]
    parts = [F.explode(F.sequence(stripe_of(START, stripe), F.floor(x / F.lit(stripe)).cast("long"))) for x in (F.col(END) - 1, F.col(END))]
    kind, none = right.schema[label].dataType, F.lit(None).cast(right.schema[label].dataType)
    rs = right.where(ok).select(SEQ, *bounds, F.col(label).alias("_label")).withColumn("_part", parts[1])  # also where it ends, as a segment may begin there
    ls = left.where(ok).select(SEQ, *bounds, none.alias("_label")).withColumn("_part", parts[0])
    columns = [SEQ, "_part", "_kind", START, END, "_label"]
    rows = _starts_after(rs, stripe).select(SEQ, "_part", START, END, none.alias("_label")).withColumn("_kind", F.lit(0)).select(*columns)
    rows = rows.unionAll(rs.withColumn("_kind", F.lit(1)).select(*columns)).unionAll(ls.withColumn("_kind", F.lit(2)).select(*columns))
    rows = rows.repartition(SEQ, "_part").sortWithinPartitions(SEQ, "_part", "_kind", "_label", START, END)
    bound = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    schema = T.StructType([T.StructField(SEQ, T.StringType()), *bound.fields, T.StructField("labels", T.ArrayType(kind)), T.StructField("lefts", T.ArrayType(bound))])
    segs = rows.mapInArrow(_sweep(stripe), schema)
    segs = segs.withColumn("labels", shape(F.col("labels")) if shape else F.col("labels")).withColumn("_l", F.explode("lefts"))
    return segs.select(SEQ, F.col("_l.s").alias("left_start"), F.col("_l.e").alias("left_end"), F.greatest("s", "_l.s").alias(START), F.least("e", "_l.e").alias(END), F.col("labels").alias(name))


def _starts_after(rows: DataFrame, stripe: int) -> DataFrame:
    """For each stripe that a range leaves at its end: the first start in later stripes, as an empty range."""
    first, here = stripe_of(START, stripe), F.col("_part")
    part = rows.groupBy(SEQ, "_part").agg(F.min(F.when(first == here, F.col(START))).alias("_first"), F.max(F.col(END) > (here + 1) * F.lit(stripe)).alias("_on"))
    later = Window.partitionBy(SEQ).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn(START, F.min("_first").over(later)).where(F.col("_on") & F.col(START).isNotNull())
    return part.select(SEQ, "_part", START, F.col(START).alias(END))


def _sweep(stripe: int) -> Callable:
    """Batches of rows sorted by stripe, of which whole stripes are taken at a time, many at once."""

    def run(batches):
        held, n, enough = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < enough:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_new_stripe(t))[-1])
            yield from _segments_of(t.slice(0, cut), stripe)
            held, n = t.slice(cut).to_batches(), n - cut
            enough = max(ROWS, 2 * n)
        if n:
            yield from _segments_of(pa.Table.from_batches(held), stripe)

    return run


def _new_stripe(t: pa.Table) -> np.ndarray:
    part, seq = t["_part"].to_numpy(), t[SEQ].combine_chunks().dictionary_encode()
    seq = (seq.combine_chunks() if isinstance(seq, pa.ChunkedArray) else seq).indices.to_numpy()
    return np.concatenate([np.ones(min(1, len(part)), bool), (part[1:] != part[:-1]) | (seq[1:] != seq[:-1])])


def _first_of_label(values: pa.Array, new: np.ndarray) -> np.ndarray:
    """Row number of the first row with this row's label; rows are sorted by label from each ``new`` on."""
    a, b = values.slice(1), values.slice(0, len(values) - 1)
    try:
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(values.type):
            same |= (pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)).to_numpy(zero_copy_only=False)
    except pa.ArrowNotImplementedError:  # nested labels
        same = np.array([x == y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    other = new.copy()
    other[1:] |= ~same
    return np.maximum.accumulate(np.where(other, np.arange(len(other)), 0))


def _merged(lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by code and start, without those that hold nothing; of a code, those that overlap or touch are one, so
    that a segment pairs with a label once."""
    lo, hi, code = (x[lo < hi] for x in (lo, hi, code))
    if not len(lo):
        return lo, hi, code
    shift = code * (int(hi.max()) + 1)
    upto = np.maximum.accumulate(hi + shift)
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (lo[1:] + shift[1:] > upto[:-1])]))
    return lo[new], np.maximum.reduceat(hi, new), code[new]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index, x) with lo[index] <= x < hi[index]."""
    n = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) + np.repeat(lo - (np.cumsum(n) - n), n)


def _segments_of(t: pa.Table, stripe: int) -> Iterator[pa.RecordBatch]:
    """Segments of whole stripes with labels and left ranges.  A pair of segment and left range belongs to the stripe where
    their intersection starts.

    The stripes are laid side by side, each with one place more at either end: before 0 is all that lies earlier, after the
    last position all that lies later.  Then two searches give the segments of every range.
    """
    t = t.combine_chunks()
    new, width = _new_stripe(t), stripe + 2
    kind, start, end, base = t["_kind"].to_numpy(), t[START].to_numpy(), t[END].to_numpy(), t["_part"].to_numpy() * stripe
    group, names = np.cumsum(new) - 1, t[SEQ].combine_chunks()
    lo, hi = (group * width + np.clip(x - base, -1, stripe) + 1 for x in (start, end))
    right = np.flatnonzero(kind == 1)
    again = np.concatenate([[False], ~new[1:] & (kind[1:] == kind[:-1]) & (start[1:] == start[:-1]) & (end[1:] == end[:-1])])
    left = np.flatnonzero((kind == 2) & ~again)
    if not len(right) or not len(left):
        return
    rlo, rhi, llo, lhi = lo[right], hi[right], lo[left], hi[left]
    at = np.unique(np.concatenate([rlo, rhi]))
    m = len(at)
    r0, r1 = np.searchsorted(at, rlo), np.searchsorted(at, rhi)
    depth = np.cumsum(np.bincount(r0, minlength=m) - np.bincount(r1, minlength=m))
    l0, l1 = np.maximum(np.searchsorted(at, llo, "right") - 1, 0), np.searchsorted(at, lhi)
    l0 += (llo % width == 0) & (at[l0] == llo)  # both began earlier
    lefts = np.cumsum(np.bincount(l0, minlength=m + 1) - np.bincount(l1, minlength=m + 1))[:m]
    want = (depth > 0) & (lefts > 0)
    to, segs = np.concatenate([[0], np.cumsum(want)]), np.flatnonzero(want)
    if not len(segs):
        return
    r0, r1, l0, l1 = to[r0], to[r1], to[l0], to[l1]
    # what goes on beyond the stripe ends with the first of its ranges, or where the next one starts
    far = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(far, group[right], np.where(rhi % width == stripe + 1, end[right], far[0]))
    np.minimum.at(far, group[kind == 0], start[kind == 0])
    heads = np.flatnonzero(new)
    own, upto = at[segs] // width, at[segs + 1] % width
    first = base[heads][own] + at[segs] % width - 1
    last = np.where(upto == stripe + 1, far[own], base[heads][own] + upto - 1)
    values = t["_label"].combine_chunks().take(pa.array(right))
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    code = _first_of_label(values, np.concatenate([[True], group[right][1:] != group[right][:-1]]))
    r0, r1, code = _merged(*(x[values.is_valid().to_numpy(zero_copy_only=False)] for x in (r0, r1, code)))
    sets = np.cumsum(np.bincount(r0, minlength=len(segs) + 1) - np.bincount(r1, minlength=len(segs) + 1))[:-1]
    load = (np.cumsum(sets + lefts[segs]) - 1) // PAIRS
    edges = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(segs)]
    for k0, k1 in zip(edges, edges[1:]):
        r = np.flatnonzero((r0 < k1) & (r1 > k0))
        which, seg = _spread(np.maximum(r0[r], k0), np.minimum(r1[r], k1))
        pairs = np.sort((seg - k0) * len(right) + code[r][which])
        ends = np.cumsum(np.bincount(pairs // len(right), minlength=k1 - k0))
        labels = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values.take(pa.array(pairs % len(right))))
        x = np.flatnonzero((l0 < k1) & (l1 > k0))
        which, seg = _spread(np.maximum(l0[x], k0), np.minimum(l1[x], k1))
        rows = left[x[which[np.argsort(seg, kind="stable")]]]
        n = np.bincount(seg - k0, minlength=k1 - k0)
        # a segment with many left ranges is several rows
        seg, piece = _spread(np.zeros(k1 - k0, np.int64), -(-n // LEFTS))
        offsets = np.concatenate([(np.cumsum(n) - n)[seg] + piece * LEFTS, [len(rows)]])
        bounds = pa.StructArray.from_arrays([pa.array(start[rows]), pa.array(end[rows])], ["s", "e"])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(heads[own[k0:k1][seg]])), pa.array(first[k0:k1][seg]), pa.array(last[k0:k1][seg]), labels.take(pa.array(seg)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), bounds)], [SEQ, "s", "e", "labels", "lefts"])

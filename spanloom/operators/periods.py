"""Continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import END, SEQ, START
from .islands import STRIPE, stripe_of, valid_rows


def session_periods(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges of a key that overlap or touch, merged by session windows whose gap is the row's own width.

    Position p is microsecond 2p and a range ends half a position late: so sessions of touching ranges overlap, and those
    of ranges one position apart do not.
    """
    gap = F.make_interval(secs=F.expr(f"CAST((2 * ({END} - {START}) + 1) * 0.000001BD AS DECIMAL(18,6))"))
    window = F.session_window(F.timestamp_micros(F.col(START) * 2), gap)
    merged = rows.groupBy(*keys, window.alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    # the optimizer takes filters on a session's bounds below the aggregate, where they are bounds of single rows: tied to
    # the count they stay above it
    position = lambda c: F.when(F.col("_n") > 0, F.shiftright(F.unix_micros(c), 1))
    return merged.select(*keys, position("_w.start").alias(START), position("_w.end").alias(END), "_n")


def striped_periods(df: DataFrame, keys: Sequence[str], stripe: int) -> tuple[DataFrame, DataFrame]:
    """Periods per key and stripe, and one row per key and stripe with what its last period must know of later stripes.

    Equal starts are reduced to the longest range first, on the map side, so that a stripe holds at most as many rows as it
    is wide.  The largest end of all earlier stripes goes into a stripe as a range of its own, which begins one position
    before it; a session that holds this range goes on from an earlier stripe.  No range is copied, however long it is.

    First table: (keys, _part, start, end) of the sessions that begin a period.  Second: (keys, _part, _last: start of the
    last of them, _reach: how far later stripes carry it on, _after: start of the next period in later stripes, _width and
    _upto: what the first table covers in the stripe and where it ends).
    """
    keys = list(keys)
    rows = valid_rows(df, keys).select(*keys, F.col(START).cast("long").alias(START), F.col(END).cast("long").alias(END))
    # never null, so that the join of the two tables asks nothing more of one of them and both come from the same exchange
    number = F.coalesce(stripe_of(START, stripe), F.lit(0))
    shape = rows.groupBy(*keys, START).agg(F.max(END).alias(END)).withColumn("_part", number)
    order = Window.partitionBy(*keys).orderBy("_part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_part") * F.lit(stripe)
    most = rows.groupBy(*keys, number.alias("_part")).agg(F.max(END).alias("_most"))
    carried = most.withColumn("_carry", F.max("_most").over(earlier)).where(F.col("_carry") >= begin)
    carried = carried.select(*keys, (begin - 1).alias(START), F.col("_carry").alias(END), "_part")
    local = session_periods(shape.select(*keys, START, END, "_part").unionByName(carried), [*keys, "_part"])
    new = F.col(START) >= begin
    part = local.groupBy(*keys, "_part").agg(F.max(F.when(new, F.col(START))).alias("_last"), F.min(F.when(new, F.col(START))).alias("_first"), F.max(F.when(~new, F.col(END))).alias("_on"), F.sum(F.when(new, F.col(END) - F.col(START))).alias("_width"), F.max(F.when(new, F.col(END))).alias("_upto"))
    part = part.withColumn("_run", F.count("_last").over(earlier))  # stripes up to the next one that begins a period go together
    part = part.withColumn("_far", F.max("_on").over(Window.partitionBy(*keys, "_run")))
    part = part.withColumns({"_reach": F.lead("_far").over(order), "_after": F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    return local.where(new).select(*keys, "_part", START, END), part.where("_last IS NOT NULL").select(*keys, "_part", "_last", "_reach", "_after", "_width", "_upto")


def _whole(df: DataFrame, keys: Sequence[str], stripe: int) -> DataFrame:
    local, part = striped_periods(df, keys, stripe)
    rows = local.join(part, [*keys, "_part"])
    return rows.withColumn(END, F.when(F.col(START) == F.col("_last"), F.greatest(END, "_reach")).otherwise(F.col(END)))


def periods(df: DataFrame, keys: Sequence[str] = (SEQ,), stripe: int = STRIPE) -> DataFrame:
    """(keys, range_start, range_end): maximal stretches that the ranges of a key cover without a gap.

    Touching ranges belong to one period.  Rows with a null key or bound and empty or inverted ranges are left out;
    no rows give no periods.  Sessions are built per key and stripe of the start, so that a hot key is many groups.
    """
    return _whole(df, keys, stripe).select(*keys, START, END)


def periods_and_gaps(df: DataFrame, keys: Sequence[str] = (SEQ,), stripe: int = STRIPE) -> DataFrame:
    """(keys, kind, range_start, range_end): the periods and, as kind 'gap', the stretch to the next period of the key:
    lead() within the stripe, for its last period the first start of the stripes that follow."""
    keys = list(keys)
    p = _whole(df, keys, stripe)
    p = p.withColumn("_next", F.coalesce(F.lead(START).over(Window.partitionBy(*keys, "_part").orderBy(START)), "_after"))
    both = F.array(F.struct(F.lit("period").alias("k"), F.col(START).alias("s"), F.col(END).alias("e")), F.struct(F.lit("gap").alias("k"), F.col(END).alias("s"), F.col("_next").alias("e")))
    rows = p.select(*keys, F.explode(both).alias("_x")).where(F.col("_x.e").isNotNull())
    return rows.select(*keys, F.col("_x.k").alias("kind"), F.col("_x.s").alias(START), F.col("_x.e").alias(END))


def covered_width(df: DataFrame, keys: Sequence[str] = (SEQ,), stripe: int = STRIPE) -> DataFrame:
    """(keys, covered_width): positions covered at least once per key, from the table of stripes alone."""
    part = striped_periods(df, keys, stripe)[1]
    more = F.greatest(F.coalesce(F.col("_reach") - F.col("_upto"), F.lit(0)), F.lit(0))
    return part.groupBy(*keys).agg(F.sum(F.col("_width") + more).cast("long").alias("covered_width"))

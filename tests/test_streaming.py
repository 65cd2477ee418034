from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanloom import RangeFrame
from spanloom.operators import merge, quantiles
from spanloom.streaming import live


@pytest.fixture
def stream(spark, tmp_path):
    """A file stream of ranges with an event time, and the rows in it."""
    rows = [("a", 5, 10, dt(2025, 1, 1, 0, 0, 0), 1.0), ("a", 8, 20, dt(2025, 1, 1, 0, 0, 30), 2.0), ("zz", 1, 2, dt(2025, 1, 1, 0, 0, 40), 3.0), ("a", 90, 95, dt(2025, 1, 1, 2, 0, 0), 4.0)]
    df = spark.createDataFrame(rows, "seqname string, range_start long, range_end long, t timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


@pytest.fixture
def drain(spark, tmp_path):
    n = [0]

    def f(df, mode="append"):
        n[0] += 1
        q = df.writeStream.format("memory").queryName(f"out{n[0]}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{n[0]}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.table(f"out{n[0]}").collect())

    return f


def test_row_wise(spark, stream, drain):
    lens = RangeFrame.seqlens_from(spark, {"a": 100})
    cols = ["seqname", "range_start", "range_end"]
    assert len(drain(live.filter_chroms(stream, lens))) == 3
    assert drain(live.adjust(stream, lens, -6, 6).select(*cols)) == [("a", 0, 16), ("a", 2, 26), ("a", 84, 100)]
    assert drain(live.flank(stream, lens, 5, None).select(*cols)) == [("a", 0, 5), ("a", 3, 8), ("a", 85, 90)]
    fixed = spark.createDataFrame([("a", 9, 12)], "seqname string, range_start long, range_end long")
    assert len(drain(live.overlaps_with(stream, fixed, 16))) == 2


def test_event_time(stream, drain):
    counts = drain(live.window_counts(stream, "t", "1 minute", "1 hour").select("seqname", "n"), "complete")
    assert counts == [("a", 1), ("a", 2), ("zz", 1)]
    p = live.merge_periods(stream, "t", F.expr("make_interval(0, 0, 0, 0, 0, 0, range_end)"), "1 minute", ["seqname"])
    assert ("a", dt(2025, 1, 1, 0, 0, 0), dt(2025, 1, 1, 0, 0, 10), 1) in drain(p)


def test_batches(spark, stream, tmp_path):
    out = []

    def keep(batch, _):
        out.extend(sorted(tuple(r) for r in merge.merge(batch.where("seqname = 'a'"), 0).collect()))

    live.each_batch(stream, keep, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert out == [("a", 5, 20), ("a", 90, 95)]


def test_percentile_partials(stream, drain, spark):
    cells = drain(live.percentile_partials(stream, ["seqname"], "v"))
    parts = spark.createDataFrame(cells, "seqname string, cell long, n long")
    got = quantiles.percentiles(quantiles.combine(parts, ["seqname"]), ["seqname"], [50]).orderBy("seqname").collect()
    assert [tuple(r) for r in got] == [("a", 3, 2.0), ("zz", 1, 3.0)]

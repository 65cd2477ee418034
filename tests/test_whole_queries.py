"""Queries over every row, where the ones with SQL take fewer, against the table."""

from pathlib import Path

import pytest

from spanloom.operators import ordering
from spanloom.plans import registry
from spanloom.plans.tables import bed3, seqlens

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables here")


def test_into_data_pairs_every_range(spark):
    rows = [(r.rid, r.seqname, r.range_start, r.range_end) for r in bed3(spark, D).collect()]
    values = sorted((i, b - a) for i, _, a, b in rows)
    want = sorted((*k, *v) for k, v in zip(sorted(r[1:] for r in rows), values))
    got = registry.QUERIES["P08_into_data_all"](spark, D).select("seqname", "range_start", "range_end", "value_id", "width")
    assert sorted(map(tuple, got.collect())) == want


def test_sort_keeps_every_range(spark):
    got = {r.position: r.rid for r in registry.QUERIES["O01_sort_all"](spark, D).collect()}
    want = [r.rid for r in ordering.sort_ranges(bed3(spark, D), seqlens(spark, D), "rid").collect()]
    assert [got[i] for i in range(len(got))] == want

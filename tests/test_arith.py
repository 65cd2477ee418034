import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom import RangeFrame
from spanloom.functions import arith as R
from spanloom.functions.nucleotide import gc_content, gc_content_strict

TC01 = [("chr1", 0, 5, 1.1), ("chr1", 4, 7, 8.1), ("chr1", 10, 17, 10.1), ("chr2", 10, 20, 3.7), ("chr2", 18, 32, 1.1)]
TC02 = [("chr1", 30, 50, 1.1), ("chr2", 100, 200, 3.7), ("chr2", 250, 300, 1.1)]


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_pairs(spark):
    w = [R.overlap_width(*p) for p in ((0, 2, 4, 6), (0, 2, 2, 6), (1, 3, 2, 5), (1, 10, 2, 5))]
    d = [R.distance_or_overlap(*p) for p in ((0, 2, 4, 6), (0, 2, 2, 6), (1, 3, 2, 5), (1, 10, 2, 5))]
    assert one(spark, *[c.alias(f"c{i}") for i, c in enumerate(w + d)]) == (0, 0, 1, 3, 2, 0, -1, -3)
    got = one(spark, R.overlap_range(5, 8, 4, 6).alias("a"), R.overlap_range(0, 2, 2, 3).alias("b"), R.overlap_range(0, 2, 3, 4).alias("c"))
    assert (tuple(got[0]), tuple(got[1]), got[2]) == ((5, 6), (2, 2), None)


def test_predicates(spark):
    null = F.lit(None).cast("long")
    got = one(spark, *[c.alias(f"c{i}") for i, c in enumerate([R.container_ok(5, 1, 10), R.container_ok(1, 10, 11), R.container_ok(1, 10, 10), R.slice_ok(1, 10, 10), R.slice_ok(3, 3, 10), R.valid_range(null, 3), R.valid_range(3, 3), R.valid_range(3, 4)])])
    assert got == (False, True, False, True, False, False, False, True)


def test_adjust(spark):
    rf = RangeFrame.from_rows(spark, [("a", 5, 10), ("a", 10, 12)], {"a": 15})
    assert [tuple(r) for r in rf.adjust_ranges(-2, 3).sort().df.collect()][0] == ("a", 3, 13)
    assert ("a", 5, 15) in [tuple(r) for r in rf.adjust_ranges(-5, 20).df.collect()]
    assert rf.adjust_ranges(5, -5).is_empty()


def test_flanks(spark, rows):
    rf = RangeFrame.from_rows(spark, TC02, {"chr1": 50, "chr2": 300}, "score double")
    assert rows(rf.flanking_ranges(10).df, "seqname", "range_start", "range_end")[:2] == [("chr1", 20, 30), ("chr2", 90, 100)]
    assert rows(rf.flanking_ranges(10, 10).df, "seqname", "range_start", "range_end") == [("chr1", 20, 30), ("chr2", 90, 100), ("chr2", 200, 210), ("chr2", 240, 250)]
    with pytest.raises(ValueError):
        rf.flanking_ranges()


def test_windows(spark):
    lens = {f"s{n}": n for n in (0, 1, 10, 11, 35, 50)}
    seqlens = RangeFrame.seqlens_from(spark, lens)
    for w, step, chop in itertools.product((5, 10), (2, 5, 10), (False, True)):
        want = sorted((q, s, min(s + w, n)) for q, n in lens.items() for s in range(0, n, step) if not (chop and s + w >= n))
        assert sorted(tuple(r) for r in RangeFrame.from_windows(seqlens, w, step, chop).df.collect()) == want


def test_windows_edges(spark):
    lens = RangeFrame.seqlens_from(spark, {"a": 50})
    assert len(RangeFrame.from_windows(lens, 10, chop=True)) == 4
    assert len(RangeFrame.from_windows(lens, 10, chop=True, keep_exact_last=True)) == 5
    with pytest.raises(ValueError):
        RangeFrame.from_windows(lens, 10, 0)


def test_window_ids_match_windows(spark):
    rng = random.Random(1)
    for _ in range(20):
        w, step = rng.randint(1, 9), rng.randint(1, 9)
        s = rng.randint(0, 60)
        e = s + rng.randint(1, 30)
        got = one(spark, R.window_ids(s, e, w, step).alias("x"))[0]
        assert got == [k for k in range(100) if k * step < e and s < k * step + w]


def test_natural_key(spark):
    names = ["chr10", "chr2", "chr1", "chrX", "chr2b", "chr002"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(R.natural_key("n"), "n")
    assert [r[0] for r in df.collect()] == ["chr1", "chr002", "chr2", "chr2b", "chr10", "chrX"]


def test_frame(spark, rows):
    rf = RangeFrame.from_rows(spark, TC01, {"chr2": 100, "chr1": 30}, "score double")
    assert rf.seqnames() == ["chr2", "chr1"]
    assert [r[0] for r in rf.iter_records()] == ["chr2", "chr2", "chr1", "chr1", "chr1"]
    assert len(rf) == 5 and not rf.is_empty() and rf.payload == ["score"]
    assert rows(rf.midpoints()) == [("chr1", 2), ("chr1", 5), ("chr1", 13), ("chr2", 15), ("chr2", 25)]
    assert rf.coverage().first()[0] == 5 + 3 + 7 + 10 + 14
    assert rf.equals(rf) and not rf.equals(rf.retain_seqnames(["chr1"]))
    assert rf.into_empty().payload == []
    assert rf.get_ranges("chr1").count() == 3
    vals = spark.createDataFrame([(i, c) for i, c in enumerate("abcde")], "i int, c string")
    paired = rf.into_data(vals, ["seqname", "range_start"], ["i"])
    assert rows(paired.df, "range_start", "c") == [(0, "a"), (4, "b"), (10, "c"), (10, "d"), (18, "e")]
    with pytest.raises(ValueError):
        rf.into_data(vals.limit(2), ["seqname", "range_start"], ["i"])


def test_checks(spark):
    from spanloom import MissingSequenceError, NoRowsError

    bad = RangeFrame.from_rows(spark, [("a", 1, 2), ("zz", 1, 2), ("a", 3, 3), (None, 1, 2)], {"a": 10}, check=False)
    with pytest.raises(MissingSequenceError, match="zz"):
        bad.require_names()
    with pytest.raises(Exception, match="unknown sequence|invalid range"):
        bad.checked().df.collect()
    assert [tuple(r) for r in bad.checked("drop", "drop").df.collect()] == [("a", 1, 2)]
    assert len(bad.exclude_seqnames(["a"])) == 2
    with pytest.raises(NoRowsError):
        bad.retain_seqnames(["q"]).require_rows()
    with pytest.raises(Exception, match="does not fit"):
        RangeFrame.from_rows(spark, [("a", 5, 11)], {"a": 10}).validated().df.collect()


def test_gc(spark):
    s = F.lit
    got = one(spark, *[c.alias(f"c{i}") for i, c in enumerate([gc_content(s("acgtn")), gc_content_strict(s("acgtn")), gc_content(s("")), gc_content_strict(s("nn")), gc_content(s(None).cast("string"))])])
    assert got == (0.6, 0.5, 0.0, 0.0, None)

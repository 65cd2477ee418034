import random

import pytest
from pyspark.sql import functions as F


from spanloom.model import RangeFrame
from spanloom.operators import join

TC01 = [("chr1", 0, 5), ("chr1", 4, 7), ("chr1", 10, 17), ("chr2", 10, 20), ("chr2", 18, 32)]


def ov(a, b):
    return a[0] is not None and a[0] == b[0] and None not in a[1:3] + b[1:3] and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize(("right", "n"), [([("chr1", 0, 1)], 1), ([("chr1", 0, 5)], 2), ([("chr1", 8, 9)], 0), ([("chr1", 4, 7), ("chr2", 10, 12)], 3)])
def test_semi_anti_golden(ranges, right, n):
    assert join.semi(ranges(TC01), ranges(right)).count() == n
    assert join.anti(ranges(TC01), ranges(right)).count() == 5 - n


def sample(rng, n, wide=False):
    out = []
    for _ in range(n):
        s = rng.randint(0, 3000)
        w = rng.choice([0, 1, 3, 50, 400] + ([100_000, 5_000_000] if wide else []))
        out.append((rng.choice(["a", "a", "b", None]), s if rng.random() > 0.05 else None, s + w - (5 if rng.random() < 0.05 else 0)))
    return out + out[:3]


@pytest.mark.parametrize(("seed", "bin_size", "levels"), [(1, None, None), (2, 7, 1), (3, 64, 2), (4, 1000, 1), (5, None, None), (6, 16, 4)])
def test_against_brute_force(ranges, rows, seed, bin_size, levels):
    rng = random.Random(seed)
    wide = bin_size is None or levels == 4
    left, right = sample(rng, 60, wide), [(*r, i) for i, r in enumerate(sample(rng, 60, wide))]
    ld, rd = ranges(left), ranges(right, "rid long")
    kw = {"bin_size": bin_size, "levels": levels}
    want = sorted((tuple(map(str, a)), b[3]) for a in left for b in right if ov(a, b))
    pairs = join.overlap_pairs(ld, rd, **kw).select("seqname", "range_start", "range_end", "r_rid").collect()
    assert sorted((tuple(map(str, r[:3])), r[3]) for r in pairs) == want
    assert sorted(map(str, join.semi(ld, rd, **kw).collect())) == sorted(str(r) for r in ld.collect() if any(ov(tuple(r), b) for b in right))
    assert join.semi(ld, rd, **kw).count() + join.anti(ld, rd, **kw).count() == len(left)
    got = join.count_overlaps(ld, rd, **kw).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(str((*a, sum(ov(a, b) for b in right))) for a in left)


def test_map_golden(ranges):
    left = ranges([("chr1", 10, 20), ("chr1", 50, 60), ("chr1", 80, 90)])
    right = ranges([("chr1", 12, 14, 3.0), ("chr1", 13, 15, 2.0), ("chr1", 16, 20, 5.0), ("chr1", 11, 12, None), ("chr1", 85, 86, float("nan")), ("chr1", 88, 90, 4.0), ("chr9", 0, 99, 1.0)], "score double")
    ops = ["sum", "sum-not-empty", "min", "max", "mean", "median", "collapse"]
    out = {r.range_start: r for r in join.map_scores(left, right, ops).collect()}
    a, b, c = out[10], out[50], out[80]
    assert (a.score_sum, a.score_min, a.score_max, a.score_median, a.score_collapse) == (10.0, 2.0, 5.0, 3.0, "3,2,5")
    assert (b.score_sum, b.score_sum_not_empty, b.score_min, b.score_mean, b.score_median, b.score_collapse) == (0.0, None, None, None, None, "")
    assert c.score_sum != c.score_sum and (c.score_min, c.score_max, c.score_median) == (4.0, 4.0, 4.0)  # the sum keeps NaN


def test_empty_and_extra_columns(ranges):
    left, none = ranges([("a", 1, 5, "x"), (None, None, None, None)], "r_score string"), ranges([], "score double")
    assert join.overlap_pairs(left, none, right_prefix="right_").count() == 0
    assert join.left_grouped(left, none).count() == 2
    assert join.anti(left, none).count() == 2 and join.semi(none, left).count() == 0
    with pytest.raises(ValueError, match="right_prefix"):
        join.overlap_pairs(left, none)
    both = join.overlap_pairs(left, ranges([("a", 4, 9, 1.0)], "score double"), right_prefix="right_").first()
    assert (both.r_score, both.right_score) == ("x", 1.0)


def test_weighted_mean_and_stats(ranges):
    left, right = ranges([("a", 0, 10), ("a", 50, 60)]), ranges([("a", 0, 4, 1.0), ("a", 8, 20, 4.0), ("a", 9, 10, None)], "score double")
    out = {r.range_start: r.weighted_mean for r in join.weighted_mean_overlaps(left, right).collect()}
    assert out == {0: (4 * 1 + 2 * 4) / 6, 50: 0.0}
    st = {r.range_start: (r.n_overlaps, r.overlap_sum, r.overlap_max) for r in join.overlap_stats(left, right).collect()}
    assert st == {0: (3, 7, 4), 50: (0, 0, 0)}


def test_equi_join_plan(ranges, spark):
    """No nested-loop or Cartesian join, and the right side's payload is pruned."""
    p = join.overlap_pairs(ranges([("a", 1, 5)]), ranges([("a", 1, 5, "p", 1.0)], "junk string, score double"), 64).select("seqname", "r_score")
    plan = p._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical"):]
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_left_grouped_order(ranges):
    got = join.left_grouped(ranges([("a", 0, 100)]), ranges([("a", 5, 9, 1), ("a", 2, 4, 2), ("a", 2, 4, 0)], "rid int")).first().overlaps
    assert [(x.range_start, x.rid) for x in got] == [(2, 0), (2, 2), (5, 1)]


@pytest.mark.parametrize(("width", "step", "chop"), [(10, None, False), (10, 3, True), (7, 20, False)])
def test_map_windows_equals_map(ranges, spark, width, step, chop):
    """The form without a join agrees with the general one, empty windows and unknown names included."""
    rng = random.Random(width)
    right = ranges([(rng.choice(["a", "b", "zz", None]), s, s + rng.choice([0, 1, 4, 30]), rng.choice([None, 1.0, 2.0, 5.0]), i) for i, s in enumerate(rng.choices(range(60), k=60))], "score double, rid int")
    lens = RangeFrame.seqlens_from(spark, {"a": 55, "b": 40, "c": 12})
    ops = ["sum", "min", "max", "mean", "median", "collapse", "sum-not-empty"]
    a = join.map_windows(right, lens, width, ops, step, chop, order=["rid"])
    b = join.map_scores(RangeFrame.from_windows(lens, width, step, chop).df, right, ops, order=["rid"], distinct=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_clashing_names(ranges):
    """Columns that look like internal ones keep their values through every operator."""
    extra = "_s long, _bin long, _len long, _stripe long, _island long, _own long, _w string, _k string, _lo long"
    row = ("a", 3, 9, 1, 2, 3, 4, 5, 6, "x", "y", 7)
    df = ranges([row, row], extra)
    frame = RangeFrame(df, RangeFrame.seqlens_from(df.sparkSession, {"a": 100}))
    tail = list(row[3:])
    assert [list(r)[3:12] for r in join.overlap_pairs(df, ranges([("a", 1, 5)]), 4).collect()] == [tail] * 2
    assert [list(r)[3:] for r in join.semi(df, ranges([("a", 1, 5)])).collect()] == [tail] * 2
    assert [list(r)[3:] for r in join.anti(df, ranges([("b", 1, 5)])).collect()] == [tail] * 2
    assert [list(r) for r in frame.adjust_ranges(-1, 1).df.collect()] == [["a", 2, 10, *tail]] * 2
    assert [list(r) for r in frame.flanking_ranges(2).df.collect()] == [["a", 1, 3, *tail]] * 2
    assert [tuple(r) for r in frame.merge(0).df.collect()] == [("a", 3, 9)]
    assert [tuple(r) for r in frame.merge(0, [F.max("_own").alias("m")]).df.collect()] == [("a", 3, 9, 6)]

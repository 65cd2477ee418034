import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import density, disjoin, merge
from spanloom.operators.islands import assign_islands, next_position
from spanloom.model import RangeFrame

TC03 = [("chr1", 0, 5, "a", 1.1), ("chr1", 4, 7, "b", 8.1), ("chr1", 10, 17, "c", 10.1), ("chr2", 10, 20, "d", 3.7), ("chr2", 18, 32, "d", 1.1)]


def fold(rows, d, same=lambda a, b: True):
    """The sequential rule over rows sorted by (seqname, start, end, order)."""
    out, last = [], None
    for r in sorted(rows):
        if last and last["first"][0] == r[0] and max(last["s"], r[1]) - min(last["e"], r[2]) <= d and same(last["first"], r):
            last["e"] = max(last["e"], r[2])
            last["n"] += 1
        else:
            last = {"first": r, "s": r[1], "e": r[2], "n": 1}
            out.append(last)
    return sorted((x["first"][0], x["s"], x["e"], x["n"]) for x in out)


def test_golden(ranges, rows):
    df = ranges(TC03, "name string, score double")
    total = [F.round(F.sum("score"), 6).alias("s")]
    assert rows(merge.merge(df, 0, total)) == [("chr1", 0, 7, 9.2), ("chr1", 10, 17, 10.1), ("chr2", 10, 32, 4.8)]
    assert rows(merge.merge(df, -2)) == [("chr1", 0, 5), ("chr1", 4, 7), ("chr1", 10, 17), ("chr2", 10, 32)]
    assert rows(merge.merge(df, 10)) == [("chr1", 0, 17), ("chr2", 10, 32)]
    assert rows(merge.merge(ranges([("a", 0, 100), ("a", 50, 52), ("a", 60, 90)]), -5)) == [("a", 0, 100), ("a", 50, 52), ("a", 60, 90)]
    want = [("chr1", 0, 5, 1.1), ("chr1", 4, 7, 8.1), ("chr1", 10, 17, 10.1), ("chr2", 10, 32, 4.8)]
    assert rows(merge.merge_runs(df, 0, "name", total)) == want
    assert rows(merge.merge_where(df, 0, lambda a, b: a["name"] == b["name"], total)) == want


def sample(rng, n=80):
    out = []
    for i in range(n):
        s = rng.randint(0, 300)
        out.append((rng.choice("ab"), s, s + rng.choice([1, 2, 5, 40]), i % 3, i))
    return out


@pytest.mark.parametrize("d", [0, 1, 7, -1, -3])
@pytest.mark.parametrize("stripe", [4, 37, 1 << 18])
def test_fold_equivalence(ranges, rows, d, stripe):
    for seed in range(2):
        data = sample(random.Random(seed))
        df = ranges(data, "k int, rid int")
        order = [(q, s, e, rid, k) for q, s, e, k, rid in data]
        n = [F.count(F.lit(1)).alias("n")]
        assert rows(merge.merge(df, d, n, stripe=stripe, order=["k", "rid"])) == fold([(q, s, e, k, rid) for q, s, e, rid, k in order], d)
        if d >= 0:
            by_k = fold([(q, s, e, rid, k) for q, s, e, k, rid in data], d, lambda a, b: a[4] == b[4])
            assert rows(merge.merge_where(df, d, lambda a, b: a["k"] == b["k"], n, stripe=stripe, order=["rid"])) == by_k
            assert rows(merge.merge_runs(df, d, "k", n, stripe=stripe, order=["rid"])) == by_k


def test_merge_edges(ranges, rows):
    odd = [("a", 5, 5), ("a", 9, 3), (None, 1, 2), ("a", None, 4), ("a", 1, 2), ("a", 1, 2), ("a", 2, 3)]
    assert rows(merge.merge(ranges(odd), 0, [F.count(F.lit(1)).alias("n")])) == [("a", 1, 3, 3)]
    assert merge.merge(ranges([]), 0).count() == 0 and merge.merge(ranges([]), -1).count() == 0
    with pytest.raises(ValueError):
        assign_islands(ranges([]), -1)
    labelled = [("a", 1, 5, None), ("a", 2, 6, None), ("a", 3, 7, "x")]
    assert rows(merge.merge_runs(ranges(labelled, "k string"), 0, "k")) == [("a", 1, 6), ("a", 3, 7)]


def test_hot_key_spreads(ranges):
    """A chain through many stripes of one key is one island."""
    df = ranges([("a", i * 100, i * 100 + 150) for i in range(500)])
    out = assign_islands(df, 0, stripe=1000)
    assert {r[0] for r in out.select("island_start").distinct().collect()} == {0}


def brute_segments(data):
    out = {}
    for q in {r[0] for r in data}:
        mine = [r for r in data if r[0] == q]
        cuts = sorted({p for r in mine for p in r[1:3]})
        for s, e in zip(cuts, cuts[1:]):
            over = [r for r in mine if r[1] < e and s < r[2]]
            if over:
                out[q, s, e] = over
    return out


@pytest.mark.parametrize("stripe", [5, 1 << 18])
def test_disjoin(ranges, rows, stripe):
    assert [(r[1], r[2], r[3]) for r in rows(disjoin.disjoin(ranges([("a", 1, 4, 0), ("a", 3, 6, 1)], "i int"), "i"))] == [(1, 3, [0]), (3, 4, [0, 1]), (4, 6, [1])]
    data = sample(random.Random(7), 40)
    df = ranges(data, "k int, rid int")
    want = brute_segments(data)
    got = {tuple(r[:3]): r[3] for r in disjoin.disjoin(df, "k", stripe=stripe).collect()}
    assert got == {k: sorted({r[3] for r in v}) for k, v in want.items()}
    assert {tuple(r[:3]): r[3] for r in disjoin.depth(df, stripe=stripe).collect()} == {k: len(v) for k, v in want.items()}
    merged = sum(r.range_end - r.range_start for r in merge.merge(df, 0).collect())
    assert merged == sum(e - s for _, s, e in want)
    assert disjoin.disjoin(ranges([], "k int"), "k").count() == 0


def test_next_position(ranges):
    df = ranges([("a", s, s + 1) for s in (1, 5, 17, 300, 4000)] + [("b", 3, 4)])
    got = {(r.seqname, r.range_start): r._next for r in next_position(df, ["seqname"], "range_start", stripe=10).collect()}
    assert got == {("a", 1): 5, ("a", 5): 17, ("a", 17): 300, ("a", 300): 4000, ("a", 4000): None, ("b", 3): None}


@pytest.mark.parametrize(("width", "step", "chop"), [(10, None, False), (10, 4, False), (10, None, True), (25, 5, True)])
def test_density(spark, ranges, rows, width, step, chop):
    rng = random.Random(3)
    data = [(q, s, e, "f" + str(k)) for q, s, e, k, _ in sample(rng, 50)]
    lens = {"a": 97, "b": 120, "c": 30}
    data = [r for r in data if r[2] <= lens[r[0]]] + [("zz", 1, 5, "f0"), ("a", 1, 5, None)]
    seqlens, df = RangeFrame.seqlens_from(spark, lens), ranges(data, "feature_name string")
    wins = [(q, s, min(s + width, n)) for q, n in lens.items() for s in range(0, n, step or width) if not (chop and s + width >= n)]
    known = [r for r in data if r[0] in lens and r[3]]
    cover = {(q, p): {r[3] for r in known if r[0] == q and r[1] <= p < r[2]} for q, n in lens.items() for p in range(n)}
    incl, excl = {}, {}
    for q, s, e in wins:
        for p in range(s, e):
            for f in cover[q, p]:
                incl[q, s, e, f] = incl.get((q, s, e, f), 0) + 1
            if cover[q, p]:
                k = (q, s, e, ",".join(sorted(cover[q, p])))
                excl[k] = excl.get(k, 0) + 1
    assert {tuple(r[:4]): r[4] for r in density.feature_density(df, seqlens, width, step, chop).collect()} == incl
    long = density.feature_density_exclusive(df, seqlens, width, step, chop)
    assert {tuple(r[:4]): r[4] for r in long.collect()} == excl
    wide = density.matrix(long, seqlens, width, step, chop, "feature_set")
    assert wide.count() == len(wins) and sum(sum(r[3:]) for r in wide.collect()) == sum(excl.values())
    assert density.matrix(long.limit(0), seqlens, width, step, chop, "feature_set").columns == ["seqname", "range_start", "range_end"]
    with pytest.raises(ValueError):
        density.matrix(long, seqlens, width, step, chop, "feature_set", most=1)


def test_disjoin_over_one_hot_position(spark):
    """100,000 ranges of a few labels over one position: pairs grow with labels, not with ranges."""
    from spanloom.operators.disjoin import disjoin, disjoin_within

    df = spark.range(100_000).select(F.lit("a").alias("seqname"), (F.col("id") % 50).alias("range_start"), F.lit(60).cast("long").alias("range_end"), F.concat(F.lit("k"), F.col("id") % 3).alias("label"))
    got = disjoin(df, "label").orderBy("range_start").collect()
    assert len(got) == 50 and all(r.labels == ["k0", "k1", "k2"] for r in got)
    left = spark.createDataFrame([("a", 5, 7), ("a", 5, 7), ("b", 0, 9), ("a", 100, 200)], "seqname string, range_start long, range_end long")
    within = disjoin_within(left, df, "label").orderBy("range_start").collect()
    assert [(r.left_start, r.left_end, r.range_start, r.range_end) for r in within] == [(5, 7, 5, 6), (5, 7, 6, 7)]


def test_disjoin_null_labels(ranges):
    from spanloom.operators.disjoin import disjoin

    out = disjoin(ranges([("a", 0, 5, None), ("a", 3, 8, "x"), ("a", 3, 8, "x")], "label string"), "label").orderBy("range_start").collect()
    assert [(r.range_start, r.range_end, r.labels) for r in out] == [(0, 3, []), (3, 5, ["x"]), (5, 8, ["x"])]


@pytest.mark.parametrize("stripe", [1, 7, 64, None])
@pytest.mark.parametrize("few", [False, True])
def test_disjoin_within_forms_no_pairs_and_shuffles_each_side_once(ranges, stripe, few, monkeypatch):
    """Against brute force, with nulls, repeated and long ranges, cut at many stripes and taken in small pieces."""
    from spanloom.operators import disjoin

    if few:
        monkeypatch.setattr(disjoin, "ROWS", 3)
        monkeypatch.setattr(disjoin, "PAIRS", 5)
        monkeypatch.setattr(disjoin, "LEFTS", 2)
    rng = random.Random(f"{stripe}{few}")
    near = lambda n, wide: [(rng.choice("abc"), s, s + rng.randint(1, rng.choice((3, wide)))) for s in (rng.randint(-20, 90) for _ in range(n))]
    odd = [(None, 1, 5), ("a", None, 5), ("a", 5, 5), ("a", 9, 2)]
    left, right = near(60, 200), [(*r, rng.choice([None, "x", "y", "é", "10", "9"])) for r in [*near(40, 60), *near(5, 150)]]
    left, right = [*left, *left[:9], *odd, ("left only", 0, 9)], [*right, *right[:9], *[(*r, "z") for r in odd], ("right only", 0, 9, "x")]
    want = {}
    for q, a, z in set(left):
        held = [(max(a, s), min(z, e), k) for n, s, e, k in right if n is not None and n == q and None not in (a, s) and a < z and s < e and s < z and a < e]
        cuts = sorted({x for s, e, _ in held for x in (s, e)})
        for p, x in zip(cuts, cuts[1:]):
            if any(s < x and p < e for s, e, _ in held):
                want[q, a, z, p, x] = sorted({k for s, e, k in held if s < x and p < e and k is not None})
    out = disjoin.disjoin_within(ranges(left), ranges(right, "k string"), "k", stripe=stripe)
    got = out.collect()
    assert len(got) == len(want) and {tuple(r[:5]): r[5] for r in got} == want
    assert out.columns == ["seqname", "left_start", "left_end", "range_start", "range_end", "labels"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_disjoin_within_labels_of_any_type(spark, ranges):
    from spanloom.operators.disjoin import disjoin_within

    left, nan = ranges([("a", 0, 10)]), float("nan")
    for kind, labels in (("double", [nan, 2.0, nan, 10.0]), ("int", [3, 2, 3, 10]), ("struct<u:int,v:string>", [(2, "b"), (1, "z"), (2, "b"), (10, "a")])):
        out = disjoin_within(left, ranges([("a", i, 9, x) for i, x in enumerate(labels)], f"k {kind}"), "k", stripe=4).orderBy("range_start").collect()
        assert [(r.range_start, r.range_end, len(r.labels)) for r in out] == [(0, 1, 1), (1, 2, 2), (2, 3, 2), (3, 9, 3)]
        last = [tuple(x) if kind.startswith("struct") else x for x in out[-1].labels]
        assert last[:2] == sorted({labels[1], labels[3 if kind == "double" else 0]}) and (last[2] == labels[3] or last[2] != last[2])
    assert disjoin_within(left, ranges([], "k int"), "k").collect() == [] == disjoin_within(ranges([]), ranges([("a", 0, 1, 2)], "k int"), "k").collect()


def test_disjoin_within_one_label_of_many_ranges(spark):
    """20,000 ranges of one label with 40,000 bounds: what is formed grows with the labels over a segment, not with the ranges."""
    from spanloom.operators.disjoin import disjoin_within

    n = 20_000
    right = spark.range(n).select(F.lit("a").alias("seqname"), F.col("id").alias("range_start"), (3 * n - F.col("id")).alias("range_end"), F.lit("x").alias("k"))
    left = spark.createDataFrame([("a", 0, 4 * n)], "seqname string, range_start long, range_end long")
    out = disjoin_within(left, right, "k", stripe=8 * n)
    assert out.count() == 2 * n - 1 and out.where("labels <> array('x')").count() == 0

import math
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.operators import quantiles as Q

SMALL = Q.Dyadic(columns=64, rows=5)


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=50))
def test_codes_keep_order(xs):
    x = np.array(sorted(xs))
    code = Q.DEFAULT.encode(x)
    assert (np.diff(code) >= 0).all()
    back = Q.DEFAULT.decode(code)
    with np.errstate(over="ignore"):
        assert (np.abs(back - x) <= np.abs(x) * 2.0**-20 + 5e-300).all()


def error(values, p, v):
    """Distance of the wanted rank from the ranks that v has within the value tolerance, as a share of n."""
    s, d = np.sort(values), abs(v) * 2.0**-20
    k = max(1, math.ceil(p / 100 * len(s)))
    return max(0, np.searchsorted(s, v - d, "left") - k, k - np.searchsorted(s, v + d, "right")) / len(s)


@pytest.mark.parametrize("shape", [Q.DEFAULT, SMALL])
@pytest.mark.parametrize("kind", ["normal", "ties", "tails"])
def test_sketch_error(shape, kind):
    rng = np.random.default_rng(5)
    x = {"normal": rng.normal(size=60_000), "ties": np.round(rng.normal(size=60_000), 1), "tails": rng.standard_cauchy(60_000)}[kind]
    code, n = np.unique(shape.encode(x), return_counts=True)
    cell, m = shape.hash_codes(code, n)
    total, got = shape.invert(cell, m, Q.PERCENTILES)
    assert total == len(x)
    limit = Q.RANK_ERROR if shape is Q.DEFAULT else 0.08
    assert max(error(x, p, v) for p, v in zip(Q.PERCENTILES, got)) <= limit


def test_exact_for_plain_codes():
    x = np.array([3.0, 1.0, 2.0, 2.0, -5.5])
    code, n = np.unique(Q.DEFAULT.encode(x), return_counts=True)
    total, got = Q.DEFAULT.invert(-1 - code, n, [1, 50, 60, 80, 99])
    assert (total, got.tolist()) == (5, [-5.5, 2.0, 2.0, 2.0, 3.0])


def test_linear_and_deletions():
    rng = np.random.default_rng(1)
    a, b = (SMALL.encode(rng.normal(size=5000)) for _ in range(2))
    one = np.ones(5000, np.int64)

    def dense(code, n):
        t = np.zeros(SMALL.cells, np.int64)
        c, v = SMALL.hash_codes(code, n)
        t[c] = v
        return t

    both = dense(np.concatenate([a, b]), np.concatenate([one, one]))
    assert (dense(a, one) + dense(b, one) == both).all()
    assert (both + dense(b, -one) == dense(a, one)).all()


def data(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", i % 4, rng.gauss(0, 10)) for i in range(6000)]
    rows += [(None, 0, 7.0), (None, 1, 7.0), ("nan", 0, float("nan")), ("nan", 0, None), ("inf", 0, float("inf"))]
    return rows, spark.createDataFrame(rows, "g string, day int, x double")


@pytest.mark.parametrize("shape", [Q.DEFAULT, Q.Dyadic(columns=32, rows=3, top=6)])
def test_groups(spark, shape):
    rows, df = data(spark)
    got = {r.g: r for r in Q.group_percentiles(df, ["g"], "x", ["day"], shape=shape, salts=2).collect()}
    assert set(got) == {"hot", None, *(f"g{i}" for i in range(5))}
    for g, r in got.items():
        x = np.array([v for k, _, v in rows if k == g])
        assert r.n == len(x)
        exact = shape is Q.DEFAULT
        assert max(error(x, p, r[f"p{p}"]) for p in Q.PERCENTILES) <= (0 if exact else 0.15)


def test_partials_merge_and_delete(spark):
    """Partial results of days give those of longer periods, and days can be taken out again."""
    rows, df = data(spark)
    parts = Q.partials(df, ["g", "day"], "x")
    once = Q.percentiles(Q.combine(parts, ["g"]), ["g"]).orderBy("g").collect()
    half = [Q.partials(df.where(f"day % 2 = {i}"), ["g"], "x") for i in (0, 1)]
    assert Q.percentiles(Q.combine(half[0].unionAll(half[1]), ["g"]), ["g"]).orderBy("g").collect() == once
    minus = Q.partials(df.where("day = 3").withColumn("w", F.lit(-1)), ["g", "day"], "x", "w")
    left = Q.percentiles(Q.combine(parts.unionAll(minus), ["g"]), ["g"]).orderBy("g").collect()
    want = Q.group_percentiles(df.where("day <> 3 OR g IS NULL OR g IN ('nan', 'inf')"), ["g"], "x").orderBy("g").collect()
    assert left == want


def test_flush_and_empty(spark):
    _, df = data(spark)
    a = Q.percentiles(Q.combine(Q.partials(df, ["g"], "x", flush=500), ["g"], flush=700), ["g"]).orderBy("g").collect()
    assert a == Q.group_percentiles(df, ["g"], "x").orderBy("g").collect()
    assert Q.group_percentiles(df.limit(0), ["g"], "x").count() == 0


def test_equal_values_in_a_sketch():
    """k equally frequent values, all hashed: the stated rank error holds."""
    for k in (50, 80, 128, 256):
        for seed in range(6):
            x = np.repeat(np.random.default_rng(seed).normal(size=k), 40)
            code, n = np.unique(Q.DEFAULT.encode(x), return_counts=True)
            _, got = Q.DEFAULT.invert(*Q.DEFAULT.hash_codes(code, n), Q.PERCENTILES)
            assert max(error(x, p, v) for p, v in zip(Q.PERCENTILES, got)) <= Q.RANK_ERROR, (k, seed)


def test_same_answers_however_the_job_is_cut(spark):
    """Hashing is decided by a group's codes over all partial results, not by what one task happens to see."""
    rng = np.random.default_rng(3)
    shape = Q.Dyadic(columns=32, rows=3, top=6)
    rows = [("large", float(v)) for v in rng.normal(size=9000)] + [("edge", float(v)) for v in rng.normal(size=shape.cells)] + [("small", float(v)) for v in rng.normal(size=300)]
    df, got = spark.createDataFrame(rows, "g string, x double"), []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for n in (1, 8, 64):
            for adaptive in ("true", "false"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                got.append(Q.group_percentiles(df.repartition(n), ["g"], "x", shape=shape).orderBy("g").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(x == got[0] for x in got)

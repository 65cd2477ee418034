import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.model import lookup_join
from spanloom.operators import hotkeys


def test_eager_equals_join(spark):
    rng = random.Random(4)
    ddl = "k1 string, k2 int, v double, w int"
    side = lambda n: [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([1, 2, None]), float(rng.randint(0, 9)), rng.randint(0, 5)) for _ in range(n)]
    left, right = spark.createDataFrame(side(90), ddl), spark.createDataFrame(side(70), ddl)
    for rollup in (None, ["k1"], []):
        got = hotkeys.eager_join_aggregate(left, right, ["k1", "k2"], {"lv": F.col("v")}, {"rw": F.col("w")}, {"vw": ("lv", "rw")}, rollup)
        j = left.join(right.withColumnsRenamed({"v": "v2", "w": "w2"}), ["k1", "k2"])
        want = j.groupBy(*(["k1", "k2"] if rollup is None else rollup)).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n_pairs"), F.sum("v").alias("lv"), F.sum("w2").alias("rw"), F.sum(F.col("v") * F.col("w2")).alias("vw"))
        cols = want.columns
        assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.collect()))


def test_eager_empty(spark):
    e = spark.createDataFrame([], "k string, v double")
    assert hotkeys.eager_join_aggregate(e, e, ["k"], {"s": F.col("v")}).count() == 0
    total = hotkeys.eager_join_aggregate(e, e, ["k"], rollup=[]).first()
    assert total.n_pairs is None


def test_plan_aggregates_before_join(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    plan = hotkeys.eager_join_aggregate(df, df, ["k"], {"s": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    first_join = plan.index("Join")
    assert plan.index("Aggregate", first_join) > first_join  # aggregates lie below the join


def test_profile(ranges):
    data = [("hot", i * 10, i * 10 + 15, float(i % 7)) for i in range(200)] + [("a", 0, 5, None), ("a", 5, 9, float("nan")), ("a", 9, 2, float("inf")), (None, 0, 5, 1.0), ("b", None, 3, 2.0)]
    out = {r.seqname: r for r in hotkeys.profile(ranges(data, "score double"), score="score").collect()}
    assert set(out) == {"hot", "a", "b"}
    assert (out["hot"].n, out["hot"].total_width, out["hot"].covered_width) == (200, 3000, 2005)
    assert (out["a"].n, out["a"].n_valid, out["a"].covered_width, out["a"].n_score, out["a"].n_null_score, out["a"].score_sum) == (3, 2, 9, 0, 1, None)
    assert (out["b"].n_valid, out["b"].total_width, out["b"].covered_width, out["b"].score_mean) == (0, 0, 0, 2.0)


def test_heavy_keys(ranges):
    one = ranges([("x", 0, 1)] * 4 + [("y", 0, 1)] * 95 + [(None, 0, 1)] * 50 + [("z", 0, 1)])
    two = ranges([("x", 0, 1)])
    got = sorted(tuple(r) for r in hotkeys.heavy_keys({"one": one, "two": two, "none": one.limit(0)}, "seqname", (4, 100)).select("table_name", "seqname").collect())
    assert got == [("one", "x"), ("one", "y"), ("two", "x")]


@pytest.mark.parametrize("rows", [0, 1000])
def test_lookup_join(spark, rows):
    """Broadcast and salted forms agree, for every kind of join."""
    fact = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "id long, k string")
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "dk string, v int")
    for how in ("left", "inner", "left_semi"):
        want = Counter(map(str, fact.join(dim, fact.k == dim.dk, how).collect()))
        assert Counter(map(str, lookup_join(fact, dim, ["k"], ["dk"], how, "id", rows=rows).collect())) == want

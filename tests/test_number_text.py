"""Text of doubles, and the two queries that write every score, against brute force."""

import math
import random
import struct
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.functions.agg import number_text
from spanloom.plans import registry


def text(x):
    if not math.isfinite(x):
        return "NaN" if x != x else "inf" if x > 0 else "-inf"
    t = format(Decimal(repr(x)), "f")
    return t[:-2] if t.endswith(".0") else t


def test_number_text(spark):
    rng = random.Random(3)
    xs = [0.0, -0.0, 2.0, -2.5, 0.001, 0.0009, 12345678.5, -12345678.5, 1e7, 1e15, 1.5e15, 1e22, 8.41e21, 2e-7, 1.7976931348623157e308, 2.0**-44, math.nan, math.inf, -math.inf]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 16) for _ in range(2000)] + [round(rng.uniform(-1e9, 1e9), rng.randint(0, 5)) for _ in range(2000)]
    wild = [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(1000)) if math.isfinite(x)]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", number_text(F.col("x"))).collect()]
    assert [(x, g, text(x)) for x, g in got if g != text(x)] == []
    back = spark.createDataFrame([(x,) for x in wild], "x double").select("x", number_text(F.col("x"))).collect()
    assert [x for x, g in back if float(g) != x or "e" in g.lower()] == []
    assert spark.createDataFrame([(None,)], "x double").select(number_text(F.col("x"))).first()[0] is None


@pytest.fixture
def folder(spark, tmp_path):
    """Scores at a half, beyond 1e14, with fractions, null and not finite."""
    scores = [0.5, 2.5, -1.5, 1e14, 3e15, 12345678.25, 0.00025, 7.0, None, math.nan, math.inf, -math.inf, 1.505]
    rows = [(i, "a" if i % 3 else "b", 999_990 + 3 * i - 20, 1_000_005 + 3 * i, None if i == 4 else f"f{i}", x) for i, x in enumerate(scores)]
    rows += [(90, None, 1, 2, "x", 1.0), (91, "a", 5, 5, "x", 1.0)]
    spark.createDataFrame(rows, "rid long, seqname string, range_start long, range_end long, feature_name string, score double").write.parquet(f"{tmp_path}/bed5_ranges.parquet")
    lens = [("g", "a", 2_500_000, 0, None), ("g", "b", 1_000_000, 1, None)]
    spark.createDataFrame(lens, "genome string, seqname string, seq_length long, ord long, removed_at timestamp").write.parquet(f"{tmp_path}/seqlens.parquet")
    return str(tmp_path), [r for r in rows if r[1] and r[3] > r[2]]


def expect_lines(rows):
    return sorted(f"{s}\t{a}\t{b}\t{'.' if n is None else n}\t{'.' if x is None else text(x)}" for _, s, a, b, n, x in rows)


def expect_collapsed(rows, lens):
    out = []
    for seq, length in lens:
        for lo in range(0, length, 1_000_000):
            hi = min(lo + 1_000_000, length)
            held = sorted((a, b, i, x) for i, s, a, b, _, x in rows if s == seq and a < hi and lo < b and x is not None)
            out.append((seq, lo, hi, ",".join(text(h[3]) for h in held)))
    return sorted(out)


def test_all_scores_are_written(spark, folder):
    d, rows = folder
    assert sorted(r.value for r in registry.QUERIES["K01_tsv_lines_all"](spark, d).collect()) == expect_lines(rows)
    assert sorted(map(tuple, registry.QUERIES["A07_collapse_all"](spark, d).collect())) == expect_collapsed(rows, [("a", 2_500_000), ("b", 1_000_000)])


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_all_scores_of_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/bed5_ranges.parquet").select("rid", "seqname", "range_start", "range_end", "feature_name", "score").collect()]
    rows = [r for r in rows if r[1] is not None and r[2] is not None and r[3] is not None and r[3] > r[2]]
    assert sorted(r.value for r in registry.QUERIES["K01_tsv_lines_all"](spark, d).collect()) == expect_lines(rows)

import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import rejects as R

CASES = [
    ("chr1\t1\t5\tn\t1.5", None),
    ("chr1\t1\t5\tn\t1.5\r", None),
    ('chr1\t1\t5\t"a\tb"\t.', None),
    ('chr1\t1\t5\t"a""b"\t.\tsurplus\t"ok"', None),
    ('chr1\t1\t5\ta"b\t.', None),
    ('"chr1"\t"1"\t"5"\t""\t"2"', None),
    ("chr1\t0001\t4294967295\t\t+.5e-3", None),
    ("\t1\t2\t\tInfinity", None),
    ("chr1\t1\t5\tn\t-NaN", None),
    ("chr1\t1\t5\tn\t1e999", None),
    ('chr1\t1\t5\t"a\t.', "bad_quoting"),
    ('chr1\t1\t5\t"a"x\t.', "bad_quoting"),
    ('chr1\tx\t"', "bad_quoting"),
    ("chr1\t1\t5\tn", "too_few_columns"),
    ("#", "skip"),
    ("", "skip"),
    ("\r", "skip"),
    ("\r\r", "too_few_columns"),
    (" ", "too_few_columns"),
    ("chr1\t-1\t5\tn\t.", "bad_start"),
    ("chr1\t\t5\tn\t.", "bad_start"),
    ("chr1\t4294967296\t5\tn\t.", "bad_start"),
    ("chr1\t１\t5\tn\t.", "bad_start"),
    ("chr1\t1\t5 \tn\t.", "bad_end"),
    ("chr1\t1\t99999999999999999999999\tn\t.", "bad_end"),
    ("chr1\t5\t5\tn\t.", "bad_range"),
    ("chr1\t9\t5\tn\tx", "bad_range"),
    ("chr1\t1\t5\tn\t", "bad_score"),
    ("chr1\t1\t5\tn\t..", "bad_score"),
    ("chr1\t1\t5\tn\t1e", "bad_score"),
    ("chr1\t1\t5\tn\t1.5\n", "bad_score"),
    ("chr1\t1\t5\tn\t0x10", "bad_score"),
    ("chr1\t1\t5\tn\tinfinit", "bad_score"),
    ("chr1\t1\t5\tn\t1_0", "bad_score"),
]


@pytest.mark.parametrize(("block", "leaf"), [(4096, 8), (4, 1), (1, 1), (7, 64)])
def test_cases(spark, block, leaf):
    df = spark.createDataFrame([(i, c, "clash") for i, (c, _) in enumerate(CASES)] + [(999, None, "x")], "line_id long, line string, score string")
    out = {r.line_id: r for r in R.parse_bed5(df, block=block, leaf=leaf).collect()}
    for i, (line, want) in enumerate(CASES):
        if want == "skip":
            assert i not in out, line
        else:
            assert out[i].reason == want, line
            assert out[i].raw_score == "clash"
            assert (out[i].range_start is None) == (want is not None)
    assert 999 not in out
    assert (out[2].feature_name, out[2].score) == ("a\tb", None)
    assert (out[3].feature_name, out[5].range_end, out[6].range_start, out[6].score) == ('a"b', 5, 1, 5e-4)
    assert math.isnan(out[8].score) and out[9].score == math.inf and out[7].seqname == ""
    assert R.valid_rows(R.parse_bed5(df)).count() + R.rejected_rows(R.parse_bed5(df)).count() == len(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='a1\t".e-+0\r\n ', min_size=1, max_size=14).map(lambda t: "c\t1\t" + t) | st.sampled_from([c for c, w in CASES if w != "skip"]), min_size=1, max_size=12))
def test_bulk_agrees_with_strict(lines):
    """Whatever the blocks, the outcome is that of the strict parser."""
    key = lambda t: [str(x) for x in t]
    table = R.parse_lines(pa.array(lines), 5, 1)
    got = list(zip(*(c.to_pylist() for c in table.columns)))
    assert [key(x) for x in got] == [key(R.parse_strictly(x)) for x in lines]


def test_bad_blocks_are_bisected(monkeypatch):
    """One bad line among many costs a few bulk calls, not one per line."""
    calls = []
    bulk = R.parse_bulk
    monkeypatch.setattr(R, "parse_bulk", lambda part: calls.append(len(part)) or bulk(part))
    rng = random.Random(0)
    lines = [f"chr1\t{i}\t{i + rng.randint(1, 9)}\tn\t{i / 7}" for i in range(4096)]
    lines[1234] = "chr1\tx\t5\tn\t."
    out = R.parse_lines(pa.array(lines), 4096, 8)
    assert out.column("reason").null_count == 4095 and len(calls) < 30


def test_empty(spark):
    assert R.parse_bed5(spark.createDataFrame([], "line string")).count() == 0
    long = "c\t1\t2\t" + "x" * 200_000 + "\t."
    assert R.parse_bed5(spark.createDataFrame([(long,)], "line string")).first().reason is None

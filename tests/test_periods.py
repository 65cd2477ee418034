import random

import pytest

from spanloom.operators.periods import periods, periods_and_gaps, session_periods


def brute(data):
    out = []
    for key in {(r[0], r[3]) for r in data if r[0] is not None and r[3] is not None}:
        mine = sorted((r[1], r[2]) for r in data if (r[0], r[3]) == key and None not in r[1:3] and r[2] > r[1])
        cur = []
        for s, e in mine:
            if cur and s <= cur[-1][1]:
                cur[-1][1] = max(cur[-1][1], e)
            else:
                cur.append([s, e])
        out += [(key[1], key[0], "period", s, e) for s, e in cur]
        out += [(key[1], key[0], "gap", a[1], b[0]) for a, b in zip(cur, cur[1:])]
    return sorted(out)


@pytest.mark.parametrize("stripe", [3, 50, 1 << 18])
def test_against_brute_force(ranges, stripe):
    for seed in range(3):
        rng = random.Random(seed)
        data = []
        for _ in range(120):
            s = rng.randint(0, 400)
            data.append((rng.choice(["a", "a", "a", "b", None]), rng.choice([s, s, s, s, None]), s + rng.choice([-3, 0, 1, 1, 2, 5, 90]), rng.choice([1, 2])))
        data += data[:10] + [("a", 4294967290, 4294967295, 1), ("b", 0, 4294967295, 2)]
        got = sorted(tuple(r) for r in periods_and_gaps(ranges(data, "bed_id long"), ["bed_id", "seqname"], stripe).collect())
        assert got == brute(data)


def test_touching_nested_chain(ranges):
    """A period that runs through many stripes, by touching and by nesting, stays one."""
    data = [("a", i * 7, i * 7 + 7) for i in range(100)] + [("a", 0, 500), ("a", 10, 20)] + [("a", 800, 801)]
    got = sorted(tuple(r) for r in periods(ranges(data), stripe=10).collect())
    assert got == [("a", 0, 700), ("a", 800, 801)]


def test_clashing_columns(ranges):
    df = ranges([("a", 1, 2, 9, "x")], "kind int, _w string")
    assert [tuple(r) for r in periods_and_gaps(df).collect()] == [("a", "period", 1, 2)]


def test_empty(ranges):
    assert periods_and_gaps(ranges([])).count() == 0
    assert periods_and_gaps(ranges([(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 5, 5)])).count() == 0


def test_hot_stripe_is_reduced(ranges):
    """Before sessions are built, the rows of a stripe are reduced to its distinct starts, on the map side first."""
    df = ranges([("a", i % 5, i % 5 + 3) for i in range(1000)])
    assert [tuple(r) for r in periods(df).collect()] == [("a", 0, 7)]
    plan = periods(df)._jdf.queryExecution().toString()
    below = plan[plan.index("== Physical"):].rpartition("MergingSessions")[2]
    assert below.count("partial_max(range_end") and "HashAggregate" in below


def test_sessions(ranges):
    assert [tuple(r)[:3] for r in session_periods(ranges([("a", 1, 5), ("a", 3, 9)]), ["seqname"]).collect()] == [("a", 1, 9)]

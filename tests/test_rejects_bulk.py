"""Which lines the strict parser reads."""

import random

import pyarrow as pa

from spanloom.operators import rejects as R


def test_only_bad_lines_are_read_strictly(monkeypatch):
    """One line in 20 is bad, each kind of reason: the other 19 are taken in bulk."""
    strict, read = R.parse_strictly, []
    monkeypatch.setattr(R, "parse_strictly", lambda line: read.append(line) or strict(line))
    bad = ["c\tx\t5\tn\t.", "c\t1", "c\t1\t99999999999\tn\t1", "c\t5\t5\tn\t1", "c\t1\t5\tn\t1_0", '"c\t1\t5\tn\t1', "c\t1\t4294967296\tn\t1", ""]
    rng = random.Random(1)
    lines = [bad[i // 20 % len(bad)] if i % 20 == 7 else f'chr1\t00{i}\t{i + rng.randint(1, 9)}\t"n""{i}"\t{rng.choice([".", "+1.5", "inf", "2e-3"])}' for i in range(10_000)]
    out = R.parse_lines(pa.array(lines))
    assert sorted(read) == sorted(x for i, x in enumerate(lines) if i % 20 == 7)
    assert [tuple(r.values()) for r in out.to_pylist()] == [strict(x) for x in lines]

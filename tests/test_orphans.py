from datetime import datetime as dt

import pytest

from spanloom.operators.orphans import Entity, Reference, orphan_cascade, orphan_report


def day(n):
    return dt(2025, 1, 1 + n) if n is not None else None


@pytest.fixture
def graph(spark):
    genomes = [("g1", day(0), None), ("g2", day(0), day(5)), ("g2", day(10), None), ("g3", day(20), None), (None, day(0), None)]
    files = [(1, "g1", day(1)), (2, "g2", day(7)), (3, "zz", day(1)), (4, None, day(1)), (5, "g3", day(2)), (6, "g2", day(5)), (7, "g2", day(10)), (8, "zz", None), (9, "g3", None)]
    rows = [(100 + i, i % 10, day(i)) for i in range(12)]
    return [
        Entity("genomes", spark.createDataFrame(genomes, "genome string, a timestamp_ntz, z timestamp_ntz"), "genome"),
        Entity("files", spark.createDataFrame(files, "id long, genome string, t timestamp_ntz"), "id", "t"),
        Entity("rows", spark.createDataFrame(rows, "rid long, file long, t timestamp_ntz"), "rid", "t"),
    ]


FILES = Reference("files", ("genome",), "genomes", ("genome",), "a", "z")
ROWS = Reference("rows", ("file",), "files", ("id",))


def test_direct(graph):
    out = {r.row_id: r.status for r in orphan_cascade(graph[:2], [FILES]).collect()}
    # at its removal a target is no longer valid; rows without a time can only be missing
    assert out == {2: "deleted", 3: "missing", 5: "late", 6: "deleted", 8: "missing"}


def test_cascade(graph):
    out = {(r.table_name, r.row_id): (r.kind, r.status) for r in orphan_cascade(graph, [FILES, ROWS]).collect()}
    assert {k[1]: v for k, v in out.items() if k[0] == "rows"} == {100: ("direct", "missing"), 110: ("direct", "missing"), 102: ("inherited", "inherited"), 103: ("inherited", "inherited"), 105: ("inherited", "inherited"), 106: ("inherited", "inherited"), 108: ("inherited", "inherited")}
    quiet = orphan_cascade(graph, [FILES, Reference("rows", ("file",), "files", ("id",), report=False)]).where("table_name = 'rows'")
    assert {r.kind for r in quiet.collect()} == {"inherited"}
    assert sum(r.n for r in orphan_report(orphan_cascade(graph, [FILES, ROWS])).collect()) == len(out)


def test_cycle(spark):
    """A self-reference runs to the fixpoint, however deep, and a ring of sound rows stays sound."""
    rows = [(i, i - 1) for i in range(1, 7)] + [(10, 11), (11, 10), (20, None)]
    e = Entity("t", spark.createDataFrame(rows, "id long, parent long"), "id")
    out = {r.row_id: r.kind for r in orphan_cascade([e], [Reference("t", ("parent",), "t", ("id",))]).collect()}
    assert out == {1: "direct", **dict.fromkeys(range(2, 7), "inherited")}


def test_empty(graph):
    none = [Entity(e.name, e.df.limit(0), e.row_id, e.time) for e in graph]
    assert orphan_cascade(none, [FILES, ROWS]).count() == 0
    no_parent = [none[0], *graph[1:]]
    assert {r.status for r in orphan_cascade(no_parent, [FILES]).collect()} == {"missing"}

"""References to records that do not exist, direct and inherited, over a graph of foreign keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import lookup_join
from ..session import cut_lineage


@dataclass(frozen=True)
class Entity:
    """A table of the graph: its rows, the unique row id and, if it has one, the time at which its references hold."""

    name: str
    df: DataFrame
    row_id: str
    time: str | None = None


@dataclass(frozen=True)
class Reference:
    """child.columns refers to parent.parent_columns; if ``since`` is given, to a parent row valid at the child's time
    (since <= time, and until null or time < until)."""

    child: str
    columns: Sequence[str]
    parent: str
    parent_columns: Sequence[str]
    since: str | None = None
    until: str | None = None
    report: bool = True


def direct(child: Entity, ref: Reference, parent: Entity) -> DataFrame:
    """(row_id, time, status) of the child's rows whose reference has no valid target.

    A reference with a null column is none.  Targets are reduced to one row per key, with the spans in which it is
    valid, before the join; that side is broadcast only if a limited count proves it small, otherwise every key is
    spread over several parts.  Rows without a time can only be 'missing'.
    """
    names = [f"_p{i}" for i in range(len(ref.columns))]
    key = [F.col(c).alias(n) for c, n in zip(ref.parent_columns, names)]
    time = F.col(child.time) if child.time else F.lit(None).cast("timestamp_ntz")
    if ref.since:
        span = F.struct(F.col(ref.since).alias("a"), (F.col(ref.until) if ref.until else F.lit(None).cast("timestamp_ntz")).alias("z"))
        targets = parent.df.select(*key, span.alias("_x")).groupBy(*names).agg(F.collect_set("_x").alias("_spans"))
    else:
        targets = parent.df.select(*key).distinct().withColumn("_spans", F.lit(None).cast("array<struct<a:timestamp_ntz,z:timestamp_ntz>>"))
    rows = child.df
    for c in ref.columns:
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.select(F.col(child.row_id).alias("row_id"), time.alias("time"), *[F.col(c).alias("_c" + n) for c, n in zip(ref.columns, names)])
    j = lookup_join(rows, targets.withColumn("_hit", F.lit(True)), ["_c" + n for n in names], names, "left", "row_id")
    missing = F.col("_hit").isNull()
    if not ref.since:
        return j.where(missing).select("row_id", "time", F.lit("missing").alias("status"))
    t = F.col("time")
    valid = F.exists("_spans", lambda x: (x["a"] <= t) & (x["z"].isNull() | (t < x["z"])))
    gone = F.exists("_spans", lambda x: x["z"].isNotNull() & (x["z"] <= t))
    orphan = missing | (t.isNotNull() & ~F.coalesce(valid, F.lit(False)))
    status = F.when(missing, "missing").when(F.coalesce(gone, F.lit(False)), "deleted").otherwise("late")
    return j.where(orphan).select("row_id", "time", status.alias("status"))


def _children_of(child: Entity, ref: Reference, parent: Entity, orphans: DataFrame) -> DataFrame:
    """Child rows whose referenced parent row is an orphan: a semi-join on the foreign key."""
    bad = orphans.select(F.col("row_id").alias("_bad"))
    lost = parent.df.join(bad, parent.df[parent.row_id] == F.col("_bad"), "left_semi").select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(ref.parent_columns)])
    time = F.col(child.time) if child.time else F.lit(None).cast("timestamp_ntz")
    keys = [f"_p{i}" for i in range(len(ref.columns))]
    return lookup_join(child.df, lost.distinct(), ref.columns, keys, "left_semi", child.row_id).select(F.col(child.row_id).alias("row_id"), time.alias("time"))


def _order(entities: Sequence[str], refs: Sequence[Reference]) -> list[str] | None:
    """Parents before children; None if the graph has a cycle."""
    left, out = set(entities), []
    while left:
        free = sorted(e for e in left if not any(r.child == e and r.parent in left for r in refs))
        if not free:
            return None
        out += free
        left -= set(free)
    return out


def orphan_cascade(entities: Sequence[Entity], refs: Sequence[Reference], max_rounds: int | None = None) -> DataFrame:
    """(table_name, row_id, time, kind, status): every orphaned row once.

    kind 'direct': a reference of the row has no valid target, status as in ``direct`` (the first by name if several).
    kind 'inherited': its references are fine, but one leads to an orphaned row; status 'inherited'.  Only references
    with report=True make direct orphans; all of them pass orphanhood on.  Without cycles one pass in the order of
    the graph is the fixpoint and runs as one plan; with cycles rounds go on until nothing is new, each cut off by a
    checkpoint.
    """
    by = {e.name: e for e in entities}
    found = {}
    for e in entities:
        parts = [direct(e, r, by[r.parent]) for r in refs if r.child == e.name and r.report]
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionAll(p)
            if len(parts) > 1:
                rows = rows.groupBy("row_id").agg(F.min("time").alias("time"), F.min("status").alias("status"))
            found[e.name] = rows.withColumn("kind", F.lit("direct"))
    order = _order(list(by), refs)
    if order is not None:
        every = dict(found)
        for name in order:
            for r in (r for r in refs if r.child == name and r.parent in every):
                lost = _children_of(by[name], r, by[r.parent], every[r.parent])
                if name in every:
                    lost = lost.join(every[name].select("row_id"), "row_id", "left_anti")
                lost = lost.select("row_id", "time", F.lit("inherited").alias("status"), F.lit("inherited").alias("kind"))
                every[name] = every[name].unionByName(lost) if name in every else lost
    else:
        every = {k: cut_lineage(v) for k, v in found.items()}
        fresh, rounds = dict(every), 0
        while fresh and (max_rounds is None or rounds < max_rounds):
            rounds, nxt = rounds + 1, {}
            for r in refs:
                if r.parent not in fresh:
                    continue
                lost = _children_of(by[r.child], r, by[r.parent], fresh[r.parent])
                for known in (every.get(r.child), nxt.get(r.child)):
                    if known is not None:
                        lost = lost.join(known.select("row_id"), "row_id", "left_anti")
                lost = lost.select("row_id", "time", F.lit("inherited").alias("status"), F.lit("inherited").alias("kind"))
                nxt[r.child] = nxt[r.child].unionByName(lost) if r.child in nxt else lost
            fresh = {}
            for name, rows in nxt.items():
                rows = cut_lineage(rows)
                if not rows.isEmpty():
                    fresh[name] = rows
                    every[name] = every[name].unionByName(rows) if name in every else rows
    out = None
    for name, rows in every.items():
        one = rows.select(F.lit(name).alias("table_name"), "row_id", "time", "kind", "status")
        out = one if out is None else out.unionAll(one)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(table_name, period, kind, status, n) per month of the row's time."""
    return orphans.groupBy("table_name", F.date_format("time", "yyyy-MM").alias("period"), "kind", "status").agg(F.count(F.lit(1)).alias("n"))

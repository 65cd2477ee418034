"""Command line: adjust, filter-chroms, filter, flank, feature-density, map, merge, windows, random-bed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NoOperationError, NoRowsError, UnsupportedFormatError
from .functions import agg as A
from .model import END, SEQ, START, RangeFrame, lookup_join
from .operators import density, join, merge
from .session import local_session
from .sinks.tsv import BED_TSV, Report, TsvConfig, write_tsv, write_tsv_folder
from .sources.random import random_ranges
from .sources.text import read_bed5, read_ranges, read_seqlens


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if "genome" in flags:
            c.add_argument("-g", "--genome", required=True)
        if "bedfile" in flags:
            c.add_argument("bedfile")
        for side in (f for f in flags if f in ("left", "right")):
            c.add_argument(f"--{side}", required=True)
        c.add_argument("-o", "--output")
        c.add_argument("--parts", action="store_true", help="write a folder of parts from the executors instead of one file")
        if "skip" in flags:
            c.add_argument("-s", "--skip-missing", action="store_true")
        return c

    c = command("adjust", "genome", "bedfile")
    c.add_argument("-b", "--both", type=int, required=True)
    c.add_argument("--sort", action="store_true")
    command("filter-chroms", "genome", "bedfile")
    command("filter", "genome", "left", "right", "skip")
    c = command("flank", "genome", "bedfile", "skip")
    c.add_argument("-b", "--both", type=int)
    c.add_argument("-l", "--left", type=int)
    c.add_argument("-r", "--right", type=int)
    c.add_argument("--in-mem", action="store_true", help="accepted; the plan is the same")
    c = command("feature-density", "genome", "bedfile")
    c.add_argument("-w", "--width", type=int, required=True)
    c.add_argument("--step", type=int)
    c.add_argument("--chop", action="store_true")
    c.add_argument("--exclusive", action="store_true")
    c.add_argument("--headers", action="store_true")
    c = command("map", "genome", "left", "right", "skip")
    c.add_argument("-f", "--func", default="")
    c = command("merge", "bedfile")
    c.add_argument("-d", "--distance", type=int, default=0)
    c.add_argument("-f", "--func")
    c = command("windows", "genome")
    c.add_argument("-w", "--width", type=int, required=True)
    c.add_argument("--step", type=int)
    c.add_argument("--chop", action="store_true")
    c = command("random-bed", "genome")
    c.add_argument("-n", "--num", type=int, required=True)
    c.add_argument("--sort", action="store_true")
    c.add_argument("--scores", action="store_true")
    return p


def _known(rf: RangeFrame, skip: bool, report: Report) -> RangeFrame:
    """Rows on sequences of the genome; unknown ones are an error unless they are to be skipped."""
    if not skip:
        return rf.require_names()
    kept = rf.filter_chroms()
    names = rf.seqlens.select(F.col(SEQ).alias("_k"), F.lit(True).alias("_hit")).distinct()
    skipped = lookup_join(rf.df.select(SEQ, START), names, [SEQ], ["_k"], "left", START).where("_hit IS NULL").count()  # one reading
    report.add_issue("rows on sequences that the genome does not hold were skipped", skipped)
    return kept


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> Report:
    a = parser().parse_args(argv)
    spark, report = spark or local_session(), Report()
    genome = read_seqlens(spark, a.genome) if getattr(a, "genome", None) else None
    load = lambda path: RangeFrame(read_ranges(spark, path)[1], genome)

    def put(df: DataFrame, config: TsvConfig = BED_TSV, ordered: bool = True) -> None:
        if a.parts and a.output:
            write_tsv_folder(df, a.output, config, genome, a.output.endswith(".gz"))
        else:
            write_tsv(df, a.output, config, genome, ordered)

    if a.command == "adjust":
        put(_known(load(a.bedfile), False, report).adjust_ranges(-a.both, a.both).df)
    elif a.command == "filter-chroms":
        put(load(a.bedfile).filter_chroms().df)
    elif a.command == "filter":
        left, right = (_known(load(x), a.skip_missing, report) for x in (a.left, a.right))
        put(left.filter_overlaps(right).df)
    elif a.command == "flank":
        if (a.both is None) == (a.left is None and a.right is None):
            raise SystemExit("flank: give --both, or --left and --right or one of them")
        rf = _known(load(a.bedfile), a.skip_missing, report)
        put(rf.flanking_ranges(a.both if a.both is not None else a.left, a.both if a.both is not None else a.right).df)
    elif a.command == "feature-density":
        kind, rows = read_ranges(spark, a.bedfile)
        if "feature_name" not in rows.columns:
            raise UnsupportedFormatError(f"{kind} has no feature names")
        f, key = (density.feature_density_exclusive, "feature_set") if a.exclusive else (density.feature_density, "feature")
        long = f(rows, genome, a.width, a.step, a.chop)
        names = [r[0] for r in (density.column_totals(long, key) if a.exclusive else long.select(key).distinct().orderBy(key)).collect()]
        wide = density.matrix(long, genome, a.width, a.step, a.chop, key, names)
        heads = ["chrom", "start", "end", *names] if a.headers or a.exclusive else None
        put(wide, TsvConfig("NA", heads))
    elif a.command == "map":
        ops = [x for x in a.func.split(",") if x]
        if not ops:
            raise NoOperationError("map needs --func")
        left = _known(load(a.left), a.skip_missing, report)
        right = _known(RangeFrame(read_bed5(spark, a.right), genome), a.skip_missing, report)
        for side in (left, right):
            if side.is_empty():
                raise NoRowsError("map needs rows on both sides")
        out = join.map_scores(left.df, right.df, ops)
        put(out.select(SEQ, START, END, *["score_" + o.replace("-", "_") for o in ops]))
    elif a.command == "merge":
        kind, rows = read_ranges(spark, a.bedfile)
        aggs = []
        if kind == "bed5":
            if not a.func:
                raise NoOperationError("merging BED5 needs --func")
            aggs = A.operations([a.func], F.col("score"), [F.col(START), F.col(END)])
        elif kind in ("bed4", "bedlike"):
            c = "feature_name" if kind == "bed4" else "rest"
            aggs = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(START, END, c))), lambda x: x[c]), ",").alias(c)]
        put(merge.merge(rows, a.distance, aggs))
    elif a.command == "windows":
        put(RangeFrame.from_windows(genome, a.width, a.step, a.chop).df)
    elif a.command == "random-bed":
        put(random_ranges(spark, genome, a.num, scores=a.scores).drop("rid"), ordered=a.sort)
    for line in report.lines():
        print(line, file=sys.stderr)
    return report


if __name__ == "__main__":
    run()

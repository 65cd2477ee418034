"""Queries p1_ to p5_: the general data-pipeline problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.agg import finite
from ..model import END, SEQ, START, lookup_join
from ..operators import hotkeys, orphans, periods, quantiles, rejects
from ..session import cut_lineage
from .tables import table


def _digits(x):
    """12 significant digits, so that the order of a float sum does not show."""
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.format_string("%.11e", x).cast("double"))


# ---- p1: a few keys hold most rows ------------------------------------------------------------------------------
def p1_found(spark, d):
    tables = {n: table(spark, d, n).select(SEQ) for n in ("bed5_ranges", "bed3_ranges")}
    return hotkeys.heavy_keys(tables, SEQ, (4, 100)).select("table_name", SEQ)


P1_FOUND = """
WITH r AS (SELECT 'bed5_ranges' AS table_name, seqname FROM bed5_ranges WHERE seqname IS NOT NULL
           UNION ALL SELECT 'bed3_ranges', seqname FROM bed3_ranges WHERE seqname IS NOT NULL),
t AS (SELECT table_name, count(*) AS total FROM r GROUP BY table_name)
SELECT r.table_name, r.seqname FROM r JOIN t ON r.table_name = t.table_name
GROUP BY r.table_name, r.seqname, t.total HAVING count(*) * 25 >= t.total"""

PROFILE = ["n", "n_valid", "total_width", "covered_width", "n_score", "n_null_score", "score_min", "score_max", "score_sum", "score_mean"]


def p1_profile(spark, d):
    b5 = hotkeys.profile(table(spark, d, "bed5_ranges"), score="score").withColumn("table_name", F.lit("bed5_ranges"))
    b5 = b5.withColumns({"score_sum": _digits(F.col("score_sum")), "score_mean": _digits(F.col("score_mean"))})
    b3 = hotkeys.profile(table(spark, d, "bed3_ranges")).withColumn("table_name", F.lit("bed3_ranges"))
    b3 = b3.withColumns({c: F.lit(None).cast("double" if c.startswith("score") else "long") for c in PROFILE[4:]})
    cols = ["table_name", SEQ, *PROFILE]
    return b5.select(*cols).unionAll(b3.select(*cols))


def _p1_profile_sql(name: str, scored: bool) -> str:
    x = "CASE WHEN isfinite(score) THEN score END"
    stats = f"""count({x}) AS n_score, sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null_score, min({x}) AS score_min, max({x}) AS score_max,
    CAST(printf('%.11e', sum({x})) AS DOUBLE) AS score_sum, CAST(printf('%.11e', avg({x})) AS DOUBLE) AS score_mean"""
    none = "NULL::BIGINT AS n_score, NULL::BIGINT AS n_null_score, NULL::DOUBLE AS score_min, NULL::DOUBLE AS score_max, NULL::DOUBLE AS score_sum, NULL::DOUBLE AS score_mean"
    return f"""
SELECT '{name}' AS table_name, a.seqname, n, n_valid, total_width, coalesce(covered_width, 0)::BIGINT AS covered_width, n_score, n_null_score, score_min, score_max, score_sum, score_mean
FROM (SELECT seqname, count(*) AS n, sum(CASE WHEN range_end > range_start THEN 1 ELSE 0 END)::BIGINT AS n_valid,
    sum(CASE WHEN range_end > range_start THEN range_end - range_start ELSE 0 END)::BIGINT AS total_width, {stats if scored else none}
  FROM {name} WHERE seqname IS NOT NULL GROUP BY seqname) a
LEFT JOIN (SELECT seqname, sum(greatest(0, range_end - greatest(range_start, coalesce(seen, range_start)))) AS covered_width
  FROM (SELECT seqname, range_start, range_end, max(range_end) OVER (PARTITION BY seqname ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM {name} WHERE seqname IS NOT NULL AND range_end > range_start) GROUP BY seqname) c ON a.seqname = c.seqname"""


P1_PROFILE = _p1_profile_sql("bed5_ranges", True) + "\nUNION ALL" + _p1_profile_sql("bed3_ranges", False)


def p1_join_profile(spark, d):
    """bed5 x bed3 ranges on (genome, seqname), rolled up to seqname; the joined rows are never formed."""
    files = table(spark, d, "bed_files").select(F.col("bed_id").alias("_b"), "genome")

    def side(name, *cols):
        rows = table(spark, d, name).select("rid", "bed_id", SEQ, START, END, *cols)
        return lookup_join(rows, files, ["bed_id"], ["_b"], "inner", "rid")

    width = F.when(F.col(END) > F.col(START), F.col(END) - F.col(START)).otherwise(0)
    score = F.when(finite(F.col("score")) & (F.abs("score") < 1e15), F.col("score")).cast("decimal(22,6)")
    out = hotkeys.eager_join_aggregate(side("bed5_ranges", "score"), side("bed3_ranges"), ["genome", SEQ], {"score_over_pairs": F.coalesce(score, F.lit(0)).cast("double"), "width5": width}, {"width3": width}, {"width_products": ("width5", "width3")}, [SEQ])
    return out.select(SEQ, F.col("n_left").alias("n5"), F.col("n_right").alias("n3"), F.col("n_pairs").cast("string").alias("n_pairs"), _digits(F.col("score_over_pairs")).alias("score_over_pairs"), _digits(F.col("width_products").cast("double")).alias("width_products"))


P1_JOIN_PROFILE = """
WITH a AS (SELECT genome, seqname, count(*) AS n, sum(CASE WHEN isfinite(score) AND abs(score) < 1e15 THEN score ELSE 0 END) AS s, sum(CASE WHEN range_end > range_start THEN range_end - range_start ELSE 0 END) AS w
  FROM bed5_ranges JOIN bed_files USING (bed_id) WHERE seqname IS NOT NULL GROUP BY ALL),
b AS (SELECT genome, seqname, count(*) AS n, sum(CASE WHEN range_end > range_start THEN range_end - range_start ELSE 0 END) AS w
  FROM bed3_ranges JOIN bed_files USING (bed_id) WHERE seqname IS NOT NULL GROUP BY ALL)
SELECT a.seqname, sum(a.n)::BIGINT AS n5, sum(b.n)::BIGINT AS n3, sum(a.n::HUGEINT * b.n)::VARCHAR AS n_pairs,
  CAST(printf('%.11e', sum(a.s * b.n)) AS DOUBLE) AS score_over_pairs, CAST(printf('%.11e', sum(a.w * b.w)::DOUBLE) AS DOUBLE) AS width_products
FROM a JOIN b ON a.genome = b.genome AND a.seqname = b.seqname GROUP BY a.seqname"""


# ---- p2: periods and gaps ---------------------------------------------------------------------------------------
def p2_found(spark, d):
    return periods.periods_and_gaps(table(spark, d, "bed3_ranges"), ["bed_id", SEQ])


P2_FOUND = """
WITH s AS (SELECT rid, bed_id, seqname, range_start, range_end, max(range_end) OVER (PARTITION BY bed_id, seqname ORDER BY range_start, range_end, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM bed3_ranges WHERE seqname IS NOT NULL AND range_end > range_start),
i AS (SELECT *, sum(CASE WHEN seen IS NULL OR range_start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY bed_id, seqname ORDER BY range_start, range_end, rid ROWS UNBOUNDED PRECEDING) AS g FROM s),
p AS (SELECT bed_id, seqname, min(range_start) AS range_start, max(range_end) AS range_end FROM i GROUP BY bed_id, seqname, g),
n AS (SELECT *, lead(range_start) OVER (PARTITION BY bed_id, seqname ORDER BY range_start) AS nxt FROM p)
SELECT bed_id, seqname, 'period' AS kind, range_start, range_end FROM n
UNION ALL SELECT bed_id, seqname, 'gap', range_end, nxt FROM n WHERE nxt IS NOT NULL"""


def p2_totals(spark, d):
    """Per file and sequence: periods, covered width, gaps and gap width."""
    x = periods.periods_and_gaps(table(spark, d, "bed3_ranges"), ["bed_id", SEQ])
    w, is_p = F.col(END) - F.col(START), F.col("kind") == "period"
    return x.groupBy("bed_id", SEQ).agg(F.count(F.when(is_p, 1)).alias("n_periods"), F.sum(F.when(is_p, w).otherwise(0)).alias("covered"), F.count(F.when(~is_p, 1)).alias("n_gaps"), F.sum(F.when(is_p, 0).otherwise(w)).alias("gap_width"))


P2_TOTALS = f"""
SELECT bed_id, seqname, count(*) FILTER (kind = 'period') AS n_periods, coalesce(sum(range_end - range_start) FILTER (kind = 'period'), 0)::BIGINT AS covered,
  count(*) FILTER (kind = 'gap') AS n_gaps, coalesce(sum(range_end - range_start) FILTER (kind = 'gap'), 0)::BIGINT AS gap_width
FROM ({P2_FOUND}) GROUP BY bed_id, seqname"""


# ---- p3: rows that fail to parse --------------------------------------------------------------------------------
def _parsed(spark, d):
    return rejects.parse_bed5(table(spark, d, "bed5_raw"), "line", ["line_id", "bed_id", "line_no"])


def p3_found(spark, d):
    return _parsed(spark, d).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_valid(spark, d):
    """The valid lines as typed rows; NaN and infinite scores as text, which compares everywhere."""
    v = rejects.valid_rows(_parsed(spark, d))
    odd = F.when(F.isnan("score"), "nan").when(~finite(F.col("score")), F.when(F.col("score") > 0, "inf").otherwise("-inf"))
    return v.select("line_id", "bed_id", "line_no", SEQ, START, END, "feature_name", F.when(odd.isNull(), F.col("score")).alias("score"), odd.alias("odd_score"))


_COL = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
_NTH = [f"regexp_extract(l, '^{(_COL + chr(92) + 't') * i}({_COL})', 1)" for i in range(5)]
_BARE = "CASE WHEN {0} LIKE '\"%' THEN replace({0}[2:-2], '\"\"', '\"') ELSE {0} END"
_P3 = f"""
WITH a AS (SELECT line_id, bed_id, line_no, CASE WHEN line LIKE '%' || chr(13) THEN line[1:-2] ELSE line END AS l FROM bed5_raw WHERE line IS NOT NULL),
b AS (SELECT *, regexp_full_match(l, '{_COL}(?:\\t{_COL})*') AS quoted_ok, regexp_matches(l, '^{_COL}(?:\\t{_COL}){{4}}(?:\\t|$)') AS five,
  {", ".join(f"{x} AS q{i}" for i, x in enumerate(_NTH))} FROM a WHERE l <> '' AND l NOT LIKE '#%'),
c AS (SELECT *, {", ".join(_BARE.format(f"q{i}") + f" AS c{i}" for i in range(5))} FROM b),
e AS (SELECT *, CASE WHEN regexp_full_match(c1, '[0-9]+') THEN TRY_CAST(CASE WHEN length(ltrim(c1, '0')) < 11 THEN '0' || ltrim(c1, '0') ELSE '9999999999' END AS BIGINT) END AS s,
  CASE WHEN regexp_full_match(c2, '[0-9]+') THEN TRY_CAST(CASE WHEN length(ltrim(c2, '0')) < 11 THEN '0' || ltrim(c2, '0') ELSE '9999999999' END AS BIGINT) END AS t FROM c),
f AS (SELECT *, CASE WHEN NOT quoted_ok THEN 'bad_quoting' WHEN NOT five THEN 'too_few_columns'
  WHEN s IS NULL OR s > 4294967295 THEN 'bad_start' WHEN t IS NULL OR t > 4294967295 THEN 'bad_end' WHEN t <= s THEN 'bad_range'
  WHEN c4 <> '.' AND NOT regexp_full_match(c4, '[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))') THEN 'bad_score' END AS reason FROM e)
"""
P3_FOUND = _P3 + "SELECT line_id, reason FROM f WHERE reason IS NOT NULL"
P3_VALID = _P3 + """, v AS (SELECT *, CASE WHEN c4 <> '.' THEN CAST(ltrim(c4, '+') AS DOUBLE) END AS x FROM f WHERE reason IS NULL)
SELECT line_id, bed_id, line_no, c0 AS seqname, s AS range_start, t AS range_end, c3 AS feature_name, CASE WHEN isfinite(x) THEN x END AS score,
  CASE WHEN isnan(x) THEN 'nan' WHEN isinf(x) THEN CASE WHEN x > 0 THEN 'inf' ELSE '-inf' END END AS odd_score FROM v"""


# ---- p4: percentiles --------------------------------------------------------------------------------------------
def _p4_merged(spark, d):
    """Partial results per file (scores) and per day (window medians), merged to (table_name, seqname)."""
    scores = quantiles.partials(table(spark, d, "bed5_ranges").select("bed_id", SEQ, "score"), ["bed_id", SEQ], "score")
    stats = quantiles.partials(table(spark, d, "map_stats").select("map_day", SEQ, "score_median"), ["map_day", SEQ], "score_median")
    both = scores.select(F.lit("bed5_ranges").alias("table_name"), SEQ, "cell", "n").unionAll(stats.select(F.lit("map_stats").alias("table_name"), SEQ, "cell", "n"))
    return quantiles.combine(both, ["table_name", SEQ])


def p4_percentiles(spark, d):
    return quantiles.percentiles(_p4_merged(spark, d), ["table_name", SEQ])


def p4_monthly(spark, d):
    """From partial results per day to those of months, over all sequences and per sequence."""
    days = quantiles.partials(table(spark, d, "map_stats").select("map_day", SEQ, "score_median"), ["map_day", SEQ], "score_median")
    months = days.withColumn("month", F.date_format("map_day", "yyyy-MM"))
    each = quantiles.percentiles(quantiles.combine(months, ["month", SEQ]), ["month", SEQ])
    every = quantiles.percentiles(quantiles.combine(months, ["month"]), ["month"])
    return each.unionByName(every.withColumn(SEQ, F.lit("*")))


def _rank_bounds(df, part, value):
    src = df.select(SEQ, F.col(value).alias("x")).where(finite(F.col(value)) & F.col(SEQ).isNotNull())
    got = quantiles.group_percentiles(df.select(part, SEQ, value), [SEQ], value, [part]).where(F.col(SEQ).isNotNull())
    long = got.select(SEQ, "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("v")) for p in quantiles.PERCENTILES])).alias("_x")).select(SEQ, "n", "_x.*")
    wide = long.groupBy(SEQ, "n").agg(F.collect_list(F.struct("p", "v")).alias("_q"))
    delta = lambda v: F.abs(v) * F.lit(2.0**-20)
    counts = src.join(wide, SEQ).select(SEQ, "n", "x", F.explode("_q").alias("_a")).groupBy(SEQ, "n", F.col("_a.p").alias("p")).agg(F.count(F.when(F.col("x") < F.col("_a.v") - delta(F.col("_a.v")), 1)).alias("below"), F.count(F.when(F.col("x") <= F.col("_a.v") + delta(F.col("_a.v")), 1)).alias("upto"))
    k, e = F.ceil(F.col("p") / 100 * F.col("n")), F.col("n") * quantiles.RANK_ERROR
    return counts.select(SEQ, F.col("p").cast("long").alias("p"), "n", ((F.col("below") <= k + e) & (F.col("upto") >= k - e)).alias("within"))


def p4_rank_bounds(spark, d):
    """For every percentile whether the promised error holds: ranks of the answers, counted exactly."""
    return _rank_bounds(table(spark, d, "bed5_ranges"), "bed_id", "score")


def p4_rank_bounds_stats(spark, d):
    """The same for the medians of map_stats, from partial results per day."""
    return _rank_bounds(table(spark, d, "map_stats"), "map_day", "score_median")


P4_RANK_BOUNDS_STATS = """
SELECT seqname, p::BIGINT AS p, n, true AS within
FROM (SELECT seqname, count(*) AS n FROM map_stats WHERE isfinite(score_median) AND seqname IS NOT NULL GROUP BY seqname), (VALUES (1), (25), (50), (75), (99)) AS q(p)"""

P4_RANK_BOUNDS = """
SELECT seqname, p::BIGINT AS p, n, true AS within
FROM (SELECT seqname, count(*) AS n FROM bed5_ranges WHERE isfinite(score) AND seqname IS NOT NULL GROUP BY seqname), (VALUES (1), (25), (50), (75), (99)) AS q(p)"""


# ---- p5: orphans ------------------------------------------------------------------------------------------------
def _p5_graph(spark, d):
    files = table(spark, d, "bed_files").select("bed_id", "genome", "uploaded_at")
    genome_of = files.select(F.col("bed_id").alias("_b"), "genome")

    def ranges(name):
        r = table(spark, d, name).select("rid", "bed_id", SEQ, "loaded_at")
        return lookup_join(r, genome_of, ["bed_id"], ["_b"], "left", "rid").drop("_b")

    entities = [
        orphans.Entity("genomes", table(spark, d, "genomes"), "genome"),
        orphans.Entity("seqlens", table(spark, d, "seqlens").withColumn("sid", F.concat_ws("|", "genome", SEQ, "added_at")), "sid"),
        orphans.Entity("bed_files", files, "bed_id", "uploaded_at"),
        orphans.Entity("bed5_ranges", ranges("bed5_ranges"), "rid", "loaded_at"),
        orphans.Entity("bed3_ranges", ranges("bed3_ranges"), "rid", "loaded_at"),
        orphans.Entity("filter_runs", table(spark, d, "filter_runs").select("run_id", "genome", "bed_id", "started_at"), "run_id", "started_at"),
    ]
    return entities


SEQ_REFS = [orphans.Reference(t, ("genome", SEQ), "seqlens", ("genome", SEQ), "added_at", "removed_at") for t in ("bed5_ranges", "bed3_ranges")]
RUN_REF = orphans.Reference("filter_runs", ("genome",), "genomes", ("genome",), "released_at", "retired_at")
FILE_REFS = [orphans.Reference("bed_files", ("genome",), "genomes", ("genome",), "released_at", "retired_at")] + [orphans.Reference(t, ("bed_id",), "bed_files", ("bed_id",), report=False) for t in ("bed5_ranges", "bed3_ranges", "filter_runs")]


def p5_found(spark, d):
    """The whole cascade, written once; of its orphans the direct ones of the three tables."""
    found = cut_lineage(orphans.orphan_cascade(_p5_graph(spark, d), [*SEQ_REFS, RUN_REF, *FILE_REFS]))
    found = found.where("kind = 'direct' AND table_name <> 'bed_files'")
    return found.select("table_name", F.date_format("time", "yyyy-MM").alias("period"), F.col("row_id").cast("long").alias("row_id"), "status")


def _p5_sql(name: str, key: str, time: str, join: str, since: str, until: str, target: str) -> str:
    return f"""SELECT '{name}' AS table_name, strftime(c.{time}, '%Y-%m') AS period, c.{key} AS row_id,
  CASE WHEN count(p.genome) = 0 THEN 'missing' WHEN bool_or(p.{until} <= c.{time}) THEN 'deleted' ELSE 'late' END AS status
FROM {join} LEFT JOIN {target} GROUP BY c.{key}, c.{time}
HAVING NOT coalesce(bool_or(p.{since} <= c.{time} AND (p.{until} IS NULL OR c.{time} < p.{until})), false)"""


_P5_RANGES = [_p5_sql(t, "rid", "loaded_at", f"(SELECT r.*, f.genome FROM {t} r LEFT JOIN bed_files f ON r.bed_id = f.bed_id WHERE r.seqname IS NOT NULL) c", "added_at", "removed_at", "seqlens p ON p.genome = c.genome AND p.seqname = c.seqname") for t in ("bed5_ranges", "bed3_ranges")]
_P5_RUNS = _p5_sql("filter_runs", "run_id", "started_at", "(SELECT * FROM filter_runs WHERE genome IS NOT NULL) c", "released_at", "retired_at", "genomes p ON p.genome = c.genome")
P5_FOUND = "\nUNION ALL\n".join([*_P5_RANGES, _P5_RUNS])


def p5_cascade(spark, d):
    """Direct and inherited orphans per table and month: a file whose genome was not valid passes that on to its rows."""
    return orphans.orphan_report(orphans.orphan_cascade(_p5_graph(spark, d), [*SEQ_REFS, RUN_REF, *FILE_REFS]))


_P5_FILES = _p5_sql("bed_files", "bed_id", "uploaded_at", "bed_files c", "released_at", "retired_at", "genomes p ON p.genome = c.genome")
P5_CASCADE = f"""
WITH files AS ({_P5_FILES}), dir AS ({P5_FOUND} UNION ALL SELECT * FROM files),
inh AS (SELECT 'bed5_ranges' AS table_name, strftime(loaded_at, '%Y-%m') AS period, rid AS row_id FROM bed5_ranges WHERE bed_id IN (SELECT row_id FROM files)
  UNION ALL SELECT 'bed3_ranges', strftime(loaded_at, '%Y-%m'), rid FROM bed3_ranges WHERE bed_id IN (SELECT row_id FROM files)
  UNION ALL SELECT 'filter_runs', strftime(started_at, '%Y-%m'), run_id FROM filter_runs WHERE bed_id IN (SELECT row_id FROM files))
SELECT table_name, period, 'direct' AS kind, status, count(*) AS n FROM dir GROUP BY ALL
UNION ALL SELECT table_name, period, 'inherited', 'inherited', count(*) FROM inh WHERE (table_name, row_id) NOT IN (SELECT (table_name, row_id) FROM dir) GROUP BY ALL"""


def p5_cycle(spark, d):
    """A graph with a cycle, to the fixpoint: each run takes the output of the run of half its number, and falls with it."""
    runs = table(spark, d, "filter_runs").select("run_id", "genome", "started_at", F.expr("run_id div 2").alias("takes"))
    entities = [orphans.Entity("genomes", table(spark, d, "genomes"), "genome"), orphans.Entity("filter_runs", runs, "run_id", "started_at")]
    refs = [RUN_REF, orphans.Reference("filter_runs", ("takes",), "filter_runs", ("run_id",), report=False)]
    return orphans.orphan_report(orphans.orphan_cascade(entities, refs))


P5_CYCLE = f"""
WITH RECURSIVE dir AS ({_P5_RUNS}),
lost AS (SELECT row_id AS run_id FROM dir UNION SELECT r.run_id FROM filter_runs r JOIN lost ON r.run_id // 2 = lost.run_id)
SELECT table_name, period, 'direct' AS kind, status, count(*) AS n FROM dir GROUP BY ALL
UNION ALL SELECT 'filter_runs', strftime(started_at, '%Y-%m'), 'inherited', 'inherited', count(*) FROM filter_runs WHERE run_id IN (SELECT run_id FROM lost) AND run_id NOT IN (SELECT row_id FROM dir) GROUP BY ALL"""


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_join_profile, p2_found, p2_totals, p3_found, p3_valid, p4_percentiles, p4_monthly, p4_rank_bounds, p4_rank_bounds_stats, p5_found, p5_cascade, p5_cycle)}
SQL = {"p1_found": P1_FOUND, "p1_profile": P1_PROFILE, "p1_join_profile": P1_JOIN_PROFILE, "p2_found": P2_FOUND, "p2_totals": P2_TOTALS, "p3_found": P3_FOUND, "p3_valid": P3_VALID, "p4_rank_bounds": P4_RANK_BOUNDS, "p4_rank_bounds_stats": P4_RANK_BOUNDS_STATS, "p5_found": P5_FOUND, "p5_cascade": P5_CASCADE, "p5_cycle": P5_CYCLE}

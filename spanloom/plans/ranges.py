"""Queries of the range operators, keyed by operator number, each with equivalent SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import agg as A
from ..functions import arith as R
from ..functions import nucleotide as N
from ..model import END, SEQ, START, RangeFrame, lookup_join
from ..operators import density, disjoin, join, merge, ordering, sequences
from ..session import shared_folder
from ..sinks.tsv import TsvConfig, to_lines, write_tsv_folder
from ..sources import random as rnd
from ..sources import sequences as seqsrc
from ..sources import text as txt
from .tables import BED3, BED5, SEQLENS, bed3, bed5, seqlens, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def digits(x):
    """12 significant digits, so that the order of a float sum does not show."""
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.format_string("%.11e", x).cast("double"))


def sql_digits(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} ELSE CAST(printf('%.11e', {x}) AS DOUBLE) END"


def lines_of(df, *cols):
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols]).alias("value"))


def frame(spark, d, which=bed3):
    return RangeFrame(which(spark, d), seqlens(spark, d))


WINDOW, STEP = 1_000_000, 500_000
MAP_WINDOW = 100_000
OV = "l.seqname = r.seqname AND l.range_start < r.range_end AND r.range_start < l.range_end"


def _windows_sql(width: int, step: int, chop: bool = False) -> str:
    return f"""(SELECT seqname, w AS range_start, least(w + {width}, seq_length) AS range_end
  FROM (SELECT seqname, seq_length, unnest(range(0::BIGINT, seq_length, {step})) AS w FROM {SEQLENS}){f' WHERE w + {width} < seq_length' if chop else ''})"""


# ---- scans: lines to typed rows ---------------------------------------------------------------------------------
@query(f"SELECT seqname, range_start, range_end FROM {BED3}")
def S02_bed3_scan(spark, d):
    return txt.parse_lines(lines_of(bed3(spark, d), SEQ, START, END, "rid"), txt.BED3)


@query(f"SELECT seqname, range_start, range_end, coalesce(feature_name, '.') AS feature_name FROM {BED5} WHERE NOT regexp_matches(coalesce(feature_name, ''), '[\\t\\n\\r]')")
def S03_bed4_scan(spark, d):
    rows = bed5(spark, d).where(~F.coalesce(F.col("feature_name"), F.lit("")).rlike(r"[\t\n\r]"))
    return txt.parse_lines(lines_of(rows, SEQ, START, END, "feature_name", "rid"), txt.BED4)


@query(f"SELECT seqname, range_start, range_end, 'f' AS feature_name, CASE WHEN isfinite(score) THEN score END AS score FROM {BED5}")
def S04_bed5_scan(spark, d):
    rows = bed5(spark, d).withColumns({"feature_name": F.lit("f"), "score": F.when(A.finite(F.col("score")), F.col("score"))})
    return txt.parse_lines(lines_of(rows, SEQ, START, END, "feature_name", "score"), txt.BED5, missing={"score": txt.MISSING})


_ODD = "CASE WHEN isnan(score) THEN 'nan' WHEN isinf(score) THEN CASE WHEN score > 0 THEN 'inf' ELSE '-inf' END END"


@query(f"SELECT seqname, range_start, range_end, coalesce(feature_name, '.') AS feature_name, CASE WHEN isfinite(score) THEN score END AS score, {_ODD} AS odd_score FROM {BED5} WHERE NOT regexp_matches(coalesce(feature_name, ''), '[\\t\\n\\r]')")
def S04_bed5_scan_all(spark, d):
    """Names and scores as they are, written by the sink's number format and read again."""
    rows = bed5(spark, d).where(~F.coalesce(F.col("feature_name"), F.lit("")).rlike(r"[\t\n\r]")).drop("rid")
    got = txt.parse_lines(to_lines(rows), txt.BED5, missing={"score": txt.MISSING})
    x = F.col("score")
    odd = F.when(F.isnan(x), "nan").when(~A.finite(x), F.when(x > 0, "inf").otherwise("-inf"))
    return got.select(SEQ, START, END, "feature_name", F.when(A.finite(x), x).alias("score"), odd.alias("odd_score"))


@query(f"SELECT rid, seqname, range_start, range_end FROM {BED3}")
def S08_gzip_folder(spark, d):
    """Written as a folder of gzip parts with the top lines beside them, read again by the scan that looks into each file."""
    place = f"{shared_folder(spark)}/tsv-{uuid4().hex}"
    write_tsv_folder(bed3(spark, d).select(SEQ, START, END, "rid"), place, TsvConfig(".", ["chrom", "start", "end", "rid"], hash_header=True), seqlens(spark, d), compress=True)
    schema = T.StructType([*txt.BED3.fields, T.StructField("rid", T.LongType())])
    return txt.read_tsv(spark, place, schema)


@query(f"SELECT seqname, seq_length FROM {SEQLENS}")
def S01_read_seqlens(spark, d):
    """The genome written as a file of the shared folder and read by its own reader."""
    place = f"{shared_folder(spark)}/genome-{uuid4().hex}"
    to_lines(seqlens(spark, d).orderBy("ord", SEQ).select(SEQ, "seq_length")).coalesce(1).write.text(place)  # a genome is small
    file = next(f for f in spark.read.text(place).inputFiles())
    return txt.read_seqlens(spark, file).select(SEQ, "seq_length")


@query("SELECT 'd' || doc_id AS seqname, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS seq_length, md5(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS text_md5 FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0")
def S15_fasta(spark, d):
    """Every text as a sequence of lines of 60 letters, written as FASTA and read line by line into chunks."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    body = F.regexp_replace(letters, "(.{60})", "$1\n")
    place = f"{shared_folder(spark)}/fasta-{uuid4().hex}"
    table(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" a text\n"), body)).write.text(place)
    chunks = seqsrc.read_fasta(spark, place, chunk=CHUNK)
    whole = chunks.groupBy(SEQ).agg(F.max("total").alias("seq_length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "chunk_text"))), lambda x: x["chunk_text"]), "").alias("t"))
    return whole.select(SEQ, "seq_length", F.md5("t").alias("text_md5"))


@query(f"SELECT 100000::BIGINT AS n, 0::BIGINT AS outside FROM (SELECT 1)")
def S21_random_inside(spark, d):
    """Random ranges are as many as asked for and lie in their sequences."""
    s = seqlens(spark, d)
    rows = RangeFrame(rnd.random_ranges(spark, s, 100_000), s).with_lengths("_len")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~R.slice_ok(START, END, "_len"), 1)).alias("outside"))


@query(f"SELECT rid, true AS same, true AS plain FROM {BED5} WHERE isfinite(score)")
def K05_number_text(spark, d):
    """The text of every finite score reads back as the same number and has no exponent."""
    rows = bed5(spark, d).where(A.finite(F.col("score"))).select("rid", F.explode(F.array(A.number_text(F.col("score")))).alias("t"), "score")
    return rows.select("rid", (F.col("t").cast("double") == F.col("score")).alias("same"), (~F.col("t").rlike("[eE]|\\.0$")).alias("plain"))


@query(f"SELECT seqname, range_start, range_end, rid::VARCHAR || chr(9) || 'x' AS rest FROM {BED3}")
def S05_bedlike_scan(spark, d):
    rows = bed3(spark, d).withColumn("x", F.lit("x  "))
    return txt.parse_lines(lines_of(rows, SEQ, START, END, "rid", "x"), txt.BEDLIKE, remainder="rest")


@query("SELECT stat_id, map_day::VARCHAR AS map_day, CASE WHEN isfinite(score_median) THEN score_median END AS score_median FROM map_stats")
def S06_typed_tsv_scan(spark, d):
    rows = table(spark, d, "map_stats").withColumn("m", F.when(A.finite(F.col("score_median")), F.col("score_median")))
    schema = T.StructType([T.StructField("stat_id", T.LongType()), T.StructField("map_day", T.DateType()), T.StructField("score_median", T.DoubleType())])
    out = txt.parse_lines(lines_of(rows, "stat_id", "map_day", "m"), schema, missing={"score_median": ("NA", ".")})
    return out.withColumn("map_day", F.col("map_day").cast("string"))


@query("SELECT (SELECT count(*) FROM bed5_raw WHERE line LIKE '#%') AS n_comments, (SELECT count(*) FROM bed5_raw WHERE line NOT LIKE '#%' AND trim(line, chr(13)) <> '') AS n_records")
def S14_preamble_counts(spark, d):
    rows = table(spark, d, "bed5_raw")
    is_comment = F.col("line").startswith("#")
    return rows.agg(F.count(F.when(is_comment, 1)).alias("n_comments"), F.count(F.when(~is_comment & (F.rtrim(F.regexp_replace("line", "\r", "")) != ""), 1)).alias("n_records"))


@query()
def S21_random_ranges(spark, d):
    return rnd.random_ranges(spark, seqlens(spark, d), 100_000, scores=True)


# ---- sinks ------------------------------------------------------------------------------------------------------
@query(f"SELECT seqname || chr(9) || range_start || chr(9) || range_end || chr(9) || coalesce(feature_name, '.') || chr(9) || CASE WHEN score IS NULL OR NOT isfinite(score) THEN '.' ELSE (round(score)::BIGINT)::VARCHAR END AS value FROM {BED5} WHERE score IS NULL OR NOT isfinite(score) OR abs(score - floor(score) - 0.5) > 0.01 AND abs(score) < 1e14")
def K01_tsv_lines(spark, d):
    x = F.col("score")
    rows = bed5(spark, d).where(x.isNull() | ~A.finite(x) | (F.abs(x - F.floor(x) - 0.5) > 0.01) & (F.abs(x) < 1e14))
    rows = rows.withColumn("score", F.when(A.finite(x), F.round(x)))
    return to_lines(rows.select(SEQ, START, END, "feature_name", "score"))


@query()
def K01_tsv_lines_all(spark, d):
    """All rows with their scores as they are; without SQL, as DuckDB writes doubles in another way."""
    return to_lines(bed5(spark, d).select(SEQ, START, END, "feature_name", "score"))


@query(f"SELECT seqname || chr(9) || range_start || chr(9) || range_end AS value FROM {BED3}")
def K02_bed3_lines(spark, d):
    return to_lines(bed3(spark, d).select(SEQ, START, END))


# ---- projections and filters ------------------------------------------------------------------------------------
@query(f"SELECT * FROM {BED3} WHERE seqname IN ('chr1', 'chr2')")
def P01_retain_seqnames(spark, d):
    return frame(spark, d).retain_seqnames(["chr1", "chr2"]).df


@query(f"SELECT * FROM {BED3} WHERE seqname NOT IN ('chr1', 'chr2')")
def P02_exclude_seqnames(spark, d):
    return frame(spark, d).exclude_seqnames(["chr1", "chr2"]).df


@query(f"SELECT rid, seqname, range_start, range_end, feature_name FROM {BED5} WHERE feature_name IS NOT NULL")
def P03_unwrap_data(spark, d):
    rf = RangeFrame(bed5(spark, d).where("feature_name IS NOT NULL").drop("score"), seqlens(spark, d))
    return rf.unwrap_data("feature_name").df


@query(f"SELECT b.* FROM {BED5} b WHERE seqname IN (SELECT seqname FROM {SEQLENS})".replace("b.*", "rid, seqname, range_start, range_end, feature_name"))
def P04_filter_chroms(spark, d):
    return frame(spark, d, bed5).filter_chroms().df.drop("score")


@query(f"SELECT seqname, range_start, range_end, rid * 2 AS twice, range_end - range_start AS w FROM {BED3}")
def P05_map_data(spark, d):
    return frame(spark, d).map_data(twice=F.col("rid") * 2, w=R.width(START, END)).df


@query(f"SELECT seqname, range_start, range_end FROM {BED5}")
def P07_into_empty(spark, d):
    return frame(spark, d, bed5).into_empty().df


@query(f"""SELECT a.seqname, a.range_start, a.range_end, b.stat_id FROM
 (SELECT *, row_number() OVER (ORDER BY rid) AS p FROM {BED3} WHERE rid IN (SELECT stat_id FROM map_stats)) a
 JOIN (SELECT stat_id, row_number() OVER (ORDER BY stat_id) AS p FROM map_stats WHERE stat_id IN (SELECT rid FROM {BED3})) b ON a.p = b.p""")
def P08_into_data(spark, d):
    b, s = bed3(spark, d), table(spark, d, "map_stats").select("stat_id")
    left = b.join(s, b["rid"] == s["stat_id"], "left_semi")
    right = s.join(b, b["rid"] == s["stat_id"], "left_semi")
    a = ordering.with_position(left, ["rid"], "_p")
    return a.join(ordering.with_position(right, ["stat_id"], "_p"), "_p").select(SEQ, START, END, "stat_id")


@query(f"""SELECT a.seqname, a.range_start, a.range_end, b.value_id, b.width FROM
 (SELECT seqname, range_start, range_end, row_number() OVER (ORDER BY seqname, range_start, range_end) AS p FROM {BED3}) a
 JOIN (SELECT rid AS value_id, range_end - range_start AS width, row_number() OVER (ORDER BY rid) AS p FROM {BED3}) b ON a.p = b.p""")
def P08_into_data_all(spark, d):
    """Every range, in range order, with the value of its position, through the length check of RangeFrame."""
    b = bed3(spark, d)
    values = b.select(F.col("rid").alias("value_id"), (F.col(END) - F.col(START)).alias("width"))
    return RangeFrame(b, seqlens(spark, d)).into_data(values, [SEQ, START, END], ["value_id"]).df


@query(f"""SELECT rid, b.range_start <= b.range_end AND b.range_end < s.seq_length AS container_ok, b.range_start < b.range_end AND b.range_end <= s.seq_length AS slice_ok
FROM {BED3} b JOIN {SEQLENS} s ON b.seqname = s.seqname""")
def P10_range_predicates(spark, d):
    rows = frame(spark, d).with_lengths("_len")
    return rows.select("rid", R.container_ok(START, END, "_len").alias("container_ok"), R.slice_ok(START, END, "_len").alias("slice_ok"))


@query(f"SELECT rid, range_start < 60000000 AND 20000000 < range_end AS hit FROM {BED3}")
def P11_has_overlap(spark, d):
    return bed3(spark, d).select("rid", R.overlaps(START, END, 20_000_000, 60_000_000).alias("hit"))


# ---- arithmetic -------------------------------------------------------------------------------------------------
def _adjust_sql(a: int, b: int, keep: str = "rid") -> str:
    return f"""SELECT {keep}, seqname, lo AS range_start, hi AS range_end FROM (SELECT *, least(greatest(range_end + {b}, lo), seq_length) AS hi FROM
 (SELECT x.*, s.seq_length, least(greatest(range_start + {a}, 0), seq_length) AS lo FROM {BED3} x JOIN {SEQLENS} s ON x.seqname = s.seqname)) WHERE hi > lo"""


@query(_adjust_sql(-10, 10))
def R02_adjust(spark, d):
    return frame(spark, d).adjust_ranges(-10, 10).df


@query(_adjust_sql(25, -25))
def R02_shrink(spark, d):
    return frame(spark, d).adjust_ranges(25, -25).df


@query(f"""SELECT * FROM (SELECT rid, x.seqname, 'left' AS side, greatest(range_start - 20, 0) AS range_start, least(range_start, seq_length) AS range_end FROM {BED3} x JOIN {SEQLENS} s ON x.seqname = s.seqname
 UNION ALL SELECT rid, x.seqname, 'right', least(range_end, seq_length), least(range_end + 30, seq_length) FROM {BED3} x JOIN {SEQLENS} s ON x.seqname = s.seqname) WHERE range_end > range_start""")
def R04_flank(spark, d):
    return frame(spark, d).flanking_ranges(20, 30, "side").df


@query(f"SELECT * FROM {_windows_sql(WINDOW, STEP)}")
def R05_windows(spark, d):
    return RangeFrame.from_windows(seqlens(spark, d), WINDOW, STEP).df


@query(f"SELECT * FROM {_windows_sql(WINDOW, WINDOW, True)}")
def R05_windows_chop(spark, d):
    return RangeFrame.from_windows(seqlens(spark, d), WINDOW, chop=True).df


@query(f"SELECT seqname, range_start, range_end, range_end - range_start AS width FROM {BED3}")
def R06_width(spark, d):
    return frame(spark, d).widths()


@query(f"SELECT seqname, (range_start + range_end) // 2 AS midpoint FROM {BED3}")
def R07_midpoints(spark, d):
    return frame(spark, d).midpoints()


_FIXED = (50_000_000, 90_000_000)


@query(f"SELECT rid, greatest(0, least(range_end, {_FIXED[1]}) - greatest(range_start, {_FIXED[0]})) AS overlap_width FROM {BED3}")
def R08_overlap_width(spark, d):
    return bed3(spark, d).select("rid", R.overlap_width(START, END, *_FIXED).alias("overlap_width"))


@query(f"SELECT rid, greatest(range_start, {_FIXED[0]}) - least(range_end, {_FIXED[1]}) AS distance FROM {BED3}")
def R09_distance_or_overlap(spark, d):
    return bed3(spark, d).select("rid", R.distance_or_overlap(START, END, *_FIXED).alias("distance"))


@query(f"SELECT rid, greatest(range_start, {_FIXED[0]}) AS lo, least(range_end, {_FIXED[1]}) AS hi FROM {BED3} WHERE greatest(range_start, {_FIXED[0]}) <= least(range_end, {_FIXED[1]})")
def R10_overlap_range(spark, d):
    r = bed3(spark, d).select("rid", R.overlap_range(START, END, *_FIXED).alias("x")).where("x IS NOT NULL")
    return r.select("rid", F.col("x.start").alias("lo"), F.col("x.end").alias("hi"))


@query(f"SELECT rid, CASE WHEN seqname = 'chr2' THEN greatest(0, least(range_end, {_FIXED[1]}) - greatest(range_start, {_FIXED[0]})) ELSE 0 END AS overlap_width FROM {BED3}")
def R11_genomic_overlap_width(spark, d):
    return bed3(spark, d).select("rid", R.genomic_overlap_width(SEQ, START, END, F.lit("chr2"), *_FIXED).alias("overlap_width"))


# ---- joins ------------------------------------------------------------------------------------------------------
@query(f"""SELECT l.rid, l.seqname, l.range_start, l.range_end, count(r.rid) AS n, coalesce(string_agg(r.rid::VARCHAR, ',' ORDER BY r.range_start, r.range_end, r.rid), '') AS right_ids
FROM {BED3} l LEFT JOIN {BED5} r ON {OV} GROUP BY ALL""")
def J01_left_overlaps(spark, d):
    out = join.left_grouped(bed3(spark, d), bed5(spark, d).select(SEQ, START, END, "rid"))
    ids = F.array_join(F.transform("overlaps", lambda x: x["rid"].cast("string")), ",")
    return out.select("rid", SEQ, START, END, F.size("overlaps").cast("long").alias("n"), ids.alias("right_ids"))


_SPANS = "coalesce(string_agg(r.range_start || '-' || r.range_end, ',' ORDER BY r.range_start, r.range_end), '') AS spans"
_TWO = f"SELECT l.seqname, l.range_start, l.range_end, {_SPANS} FROM (SELECT rid, seqname, range_start, range_end FROM {BED3}) l LEFT JOIN {BED5} r ON {OV} GROUP BY l.rid, l.seqname, l.range_start, l.range_end"


def _spans(left, right, *keep):
    """Grouped overlaps with ranges that carry no data on the right."""
    out = join.left_grouped(left, right)
    text = F.array_join(F.transform("overlaps", lambda x: F.concat(x[START].cast("string"), F.lit("-"), x[END].cast("string"))), ",")
    return out.select(*keep, SEQ, START, END, text.alias("spans"))


@query(_TWO.replace("SELECT l.seqname", "SELECT l.rid, l.seqname", 1))
def J02_left_overlaps_right_empty(spark, d):
    return _spans(bed3(spark, d), frame(spark, d, bed5).into_empty().df, "rid")


@query(f"SELECT l.seqname, l.range_start, l.range_end, count(r.rid) AS n, sum(r.rid)::BIGINT AS rid_sum FROM {BED3} l LEFT JOIN {BED5} r ON {OV} GROUP BY l.rid, l.seqname, l.range_start, l.range_end")
def J03_left_overlaps_left_empty(spark, d):
    out = join.left_grouped(frame(spark, d).into_empty().df, bed5(spark, d).select(SEQ, START, END, "rid"))
    total = F.when(F.size("overlaps") > 0, F.aggregate("overlaps", F.lit(0).cast("long"), lambda a, x: a + x["rid"]))
    return out.select(SEQ, START, END, F.size("overlaps").cast("long").alias("n"), total.alias("rid_sum"))


@query(_TWO)
def J04_left_overlaps_both_empty(spark, d):
    return _spans(frame(spark, d).into_empty().df, frame(spark, d, bed5).into_empty().df)


@query(f"SELECT l.rid, count(r.rid) AS n, count(DISTINCT r.feature_name) AS n_names, max(r.score) FILTER (isfinite(r.score)) AS top_score FROM {BED3} l LEFT JOIN {BED5} r ON {OV} GROUP BY l.rid")
def J05_map_joins_all(spark, d):
    """Over all rows; only the aggregate leaves non-finite scores out."""
    x = F.col("r_score")
    aggs = [F.count(F.lit(1)).alias("n"), F.countDistinct("r_feature_name").alias("n_names"), F.max(F.when(A.finite(x), x)).alias("top_score")]
    return join.map_overlaps(bed3(spark, d), bed5(spark, d), aggs, fill={"n": 0, "n_names": 0}).select("rid", "n", "n_names", "top_score")


@query(f"SELECT l.rid, max(r.score) AS top_score, count(DISTINCT r.feature_name) AS n_names FROM {BED3} l LEFT JOIN (SELECT * FROM {BED5} WHERE isfinite(score)) r ON {OV} GROUP BY l.rid")
def J05_map_joins(spark, d):
    right = bed5(spark, d).where(A.finite(F.col("score")))
    aggs = [F.max("r_score").alias("top_score"), F.countDistinct("r_feature_name").alias("n_names")]
    return join.map_overlaps(bed3(spark, d), right, aggs, fill={"n_names": 0}).select("rid", "top_score", "n_names")


@query(f"SELECT l.* FROM {BED3} l WHERE EXISTS (SELECT 1 FROM {BED5} r WHERE {OV})")
def J06_filter_overlaps(spark, d):
    return join.semi(bed3(spark, d), bed5(spark, d))


@query(f"SELECT l.rid, l.seqname, l.range_start, l.range_end, l.feature_name FROM {BED5} l WHERE EXISTS (SELECT 1 FROM {BED3} r WHERE {OV})")
def J07_filter_overlaps_data(spark, d):
    return join.semi(bed5(spark, d), bed3(spark, d)).drop("score")


@query(f"SELECT l.* FROM {BED3} l WHERE NOT EXISTS (SELECT 1 FROM {BED5} r WHERE {OV})")
def J08_antifilter_overlaps(spark, d):
    return join.anti(bed3(spark, d), bed5(spark, d))


@query(f"SELECT l.rid, l.seqname, l.range_start, l.range_end, l.feature_name FROM {BED5} l WHERE NOT EXISTS (SELECT 1 FROM {BED3} r WHERE {OV})")
def J09_antifilter_overlaps_data(spark, d):
    return join.anti(bed5(spark, d), bed3(spark, d)).drop("score")


@query(f"SELECT l.rid, count(r.rid) AS n_overlaps FROM {BED3} l LEFT JOIN {BED5} r ON {OV} GROUP BY l.rid")
def J11_count_overlaps(spark, d):
    return join.count_overlaps(bed3(spark, d), bed5(spark, d)).select("rid", "n_overlaps")


_W = "least(l.range_end, r.range_end) - greatest(l.range_start, r.range_start)"


@query(f"SELECT l.rid, count(r.rid) AS n_overlaps, coalesce(sum({_W}), 0)::BIGINT AS overlap_sum, coalesce(max({_W}), 0)::BIGINT AS overlap_max FROM {BED3} l LEFT JOIN {BED5} r ON {OV} GROUP BY l.rid".replace(f"sum({_W})", f"sum(CASE WHEN r.rid IS NOT NULL THEN {_W} END)").replace(f"max({_W})", f"max(CASE WHEN r.rid IS NOT NULL THEN {_W} END)"))
def J12_overlap_stats(spark, d):
    return join.overlap_stats(bed3(spark, d), bed5(spark, d)).select("rid", "n_overlaps", "overlap_sum", "overlap_max")


_SEGMENTS = f"""(SELECT seqname, p AS range_start, q AS range_end FROM (SELECT seqname, p, lead(p) OVER w AS q, sum(dd) OVER (w ROWS UNBOUNDED PRECEDING) AS depth
 FROM (SELECT seqname, p, sum(dd) AS dd FROM (SELECT seqname, range_start AS p, 1 AS dd FROM {BED3} UNION ALL SELECT seqname, range_end, -1 FROM {BED3}) GROUP BY ALL) WINDOW w AS (PARTITION BY seqname ORDER BY p)) WHERE depth > 0)"""


@query(f"SELECT l.seqname, l.range_start, l.range_end, string_agg(r.rid::VARCHAR, ',' ORDER BY r.rid) AS ids FROM {_SEGMENTS} l JOIN {BED3} r ON {OV} GROUP BY ALL")
def J15_disjoin(spark, d):
    out = disjoin.disjoin(bed3(spark, d), "rid", merged=True)  # a rid is one range
    return out.select(SEQ, START, END, F.array_join("labels", ",").alias("ids"))


_CLIPPED = f"(SELECT l.seqname, l.range_start AS a, l.range_end AS z, greatest(l.range_start, r.range_start) AS s, least(l.range_end, r.range_end) AS e, r.rid FROM (SELECT DISTINCT seqname, range_start, range_end FROM {BED5}) l JOIN {BED3} r ON {OV})"


@query(f"""WITH c AS {_CLIPPED}, p AS (SELECT seqname, a, z, s AS p FROM c UNION SELECT seqname, a, z, e FROM c),
 g AS (SELECT *, lead(p) OVER (PARTITION BY seqname, a, z ORDER BY p) AS q FROM p)
 SELECT g.seqname, g.a AS left_start, g.z AS left_end, g.p AS range_start, g.q AS range_end, string_agg(DISTINCT c.rid::VARCHAR, ',' ORDER BY c.rid::VARCHAR) AS ids
 FROM g JOIN c ON g.seqname = c.seqname AND g.a = c.a AND g.z = c.z AND c.s < g.q AND g.p < c.e WHERE g.q IS NOT NULL GROUP BY ALL""")
def J15_disjoin_within(spark, d):
    """Segments of the bed3 ranges within each distinct bed5 range, cut off at its bounds."""
    rows = bed3(spark, d).withColumn("id", F.col("rid").cast("string"))
    return disjoin.disjoin_within(bed5(spark, d), rows, "id", "ids", shape=lambda labels: F.array_join(labels, ","))


@query(_SEGMENTS[1:-1].replace("SELECT seqname, p AS range_start, q AS range_end", "SELECT seqname, p AS range_start, q AS range_end, depth::BIGINT AS depth", 1))
def J15_depth(spark, d):
    return disjoin.depth(bed3(spark, d))


@query(f"SELECT l.rid AS rid, r.rid AS r_rid, {_W} AS overlap_width FROM {BED3} l JOIN {BED5} r ON {OV}")
def J18_inner_overlaps(spark, d):
    p = join.overlap_pairs(bed3(spark, d), bed5(spark, d).select("rid", SEQ, START, END))
    return p.select("rid", "r_rid", R.overlap_width(START, END, "r_range_start", "r_range_end").alias("overlap_width"))


# ---- aggregates over windows ------------------------------------------------------------------------------------
_X = "r.score"
_MAP = f"""SELECT l.seqname, l.range_start, l.range_end, coalesce({sql_digits(f"sum({_X})")}, 0) AS score_sum, {sql_digits(f"sum({_X})")} AS score_sum_not_empty,
 min({_X}) FILTER (isfinite({_X})) AS score_min, max({_X}) FILTER (isfinite({_X})) AS score_max, {sql_digits(f"avg({_X})")} AS score_mean, {sql_digits(f"median({_X}) FILTER (NOT isnan({_X}))")} AS score_median
FROM {_windows_sql(MAP_WINDOW, MAP_WINDOW)} l LEFT JOIN (SELECT * FROM {BED5} WHERE score IS NOT NULL) r ON {OV} GROUP BY ALL"""


def _map(spark, d, ops):
    out = join.map_windows(bed5(spark, d), seqlens(spark, d), MAP_WINDOW, ops)
    return out.withColumns({c: digits(F.col(c)) for c in out.columns if c in ("score_sum", "score_sum_not_empty", "score_mean", "score_median")})


@query(_MAP)
def A08_map(spark, d):
    return _map(spark, d, ["sum", "sum-not-empty", "min", "max", "mean", "median"])


@query(_MAP.replace(f"FROM {_windows_sql(MAP_WINDOW, MAP_WINDOW)} l", f"FROM (SELECT DISTINCT seqname, range_start, range_end FROM {BED3}) l"))
def A08_map_ranges(spark, d):
    """The map command over ranges of any shape."""
    left = bed3(spark, d).select(SEQ, START, END).distinct()
    out = join.map_scores(left, bed5(spark, d), ["sum", "sum-not-empty", "min", "max", "mean", "median"])
    return out.withColumns({c: digits(F.col(c)) for c in out.columns if c in ("score_sum", "score_sum_not_empty", "score_mean", "score_median")})


for _i, _op in enumerate(["sum", "sum-not-empty", "min", "max", "mean", "median"], 1):
    _name, _col = f"A0{_i}_{_op.replace('-', '_')}", "score_" + _op.replace("-", "_")
    QUERIES[_name] = lambda spark, d, op=_op: _map(spark, d, [op])
    SQL[_name] = f"SELECT seqname, range_start, range_end, {_col} FROM ({_MAP})"


@query(f"SELECT l.seqname, l.range_start, l.range_end, coalesce(string_agg(round(r.score)::BIGINT::VARCHAR, ',' ORDER BY r.range_start, r.range_end, r.rid), '') AS score_collapse FROM {_windows_sql(WINDOW, WINDOW)} l LEFT JOIN (SELECT * FROM {BED5} WHERE isfinite(score) AND abs(score) < 1e14 AND abs(score - floor(score) - 0.5) > 0.01) r ON {OV} GROUP BY ALL")
def A07_collapse(spark, d):
    x = F.col("score")
    right = bed5(spark, d).where(A.finite(x) & (F.abs(x) < 1e14) & (F.abs(x - F.floor(x) - 0.5) > 0.01)).withColumn("score", F.round("score"))
    windows = RangeFrame.from_windows(seqlens(spark, d), WINDOW).df
    return join.map_scores(windows, right, ["collapse"], order=["rid"], bin_size=WINDOW)


@query()
def A07_collapse_all(spark, d):
    """All scores as they are; without SQL, as DuckDB writes doubles in another way."""
    windows = RangeFrame.from_windows(seqlens(spark, d), WINDOW).df
    return join.map_scores(windows, bed5(spark, d), ["collapse"], order=["rid"], bin_size=WINDOW)


@query(f"SELECT coalesce(sum(range_end - range_start), 0)::BIGINT AS coverage FROM {BED3}")
def A09_coverage(spark, d):
    return frame(spark, d).coverage()


@query(f"SELECT l.rid, coalesce({sql_digits(f'sum(r.score * ({_W})) / sum({_W})')}, 0) AS weighted_mean FROM {BED3} l LEFT JOIN (SELECT * FROM {BED5} WHERE isfinite(score)) r ON {OV} GROUP BY l.rid".replace(f"sum({_W})", f"sum(CASE WHEN r.rid IS NOT NULL THEN {_W} END)"))
def A10_weighted_mean(spark, d):
    out = join.weighted_mean_overlaps(bed3(spark, d), bed5(spark, d).where(A.finite(F.col("score"))))
    return out.select("rid", digits(F.col("weighted_mean")).alias("weighted_mean"))


# ---- merges -----------------------------------------------------------------------------------------------------
def _islands_sql(src: str, distance: int, keys: str = "seqname") -> str:
    return f"""(SELECT *, sum(CASE WHEN seen IS NULL OR range_start > seen + {distance} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY range_start, range_end, rid ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT *, max(range_end) OVER (PARTITION BY {keys} ORDER BY range_start, range_end, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {src}))"""


@query(f"SELECT seqname, min(range_start) AS range_start, max(range_end) AS range_end FROM {_islands_sql(BED3, 0)} GROUP BY seqname, g")
def M01_merge(spark, d):
    return merge.merge(bed3(spark, d), 0)


@query(f"SELECT seqname, min(range_start) AS range_start, max(range_end) AS range_end, count(*) AS n FROM {_islands_sql(BED3, 100)} GROUP BY seqname, g")
def M01_merge_distance(spark, d):
    return merge.merge(bed3(spark, d), 100, [F.count(F.lit(1)).alias("n")])


@query(f"SELECT seqname, min(range_start) AS range_start, max(range_end) AS range_end, {sql_digits('sum(score)')} AS score_sum_not_empty, {sql_digits('median(score)')} AS score_median FROM {_islands_sql(f'(SELECT rid, seqname, range_start, range_end, CASE WHEN isfinite(score) THEN score END AS score FROM {BED5})', 10)} GROUP BY seqname, g")
def M03_merge_scores(spark, d):
    rows = bed5(spark, d).withColumn("score", F.when(A.finite(F.col("score")), F.col("score")))
    out = merge.merge(rows, 10, A.operations(["sum-not-empty", "median"], F.col("score")))
    return out.withColumns({c: digits(F.col(c)) for c in ("score_sum_not_empty", "score_median")})


_RUNS = f"""(SELECT *, sum(t) OVER (PARTITION BY seqname ORDER BY range_start, range_end, rid ROWS UNBOUNDED PRECEDING) AS run FROM
 (SELECT *, CASE WHEN rid % 3 IS NOT DISTINCT FROM lag(rid % 3) OVER (PARTITION BY seqname ORDER BY range_start, range_end, rid) THEN 0 ELSE 1 END AS t FROM {BED3}))"""


@query(f"SELECT seqname, min(range_start) AS range_start, max(range_end) AS range_end, count(*) AS n FROM {_islands_sql(_RUNS, 0, 'seqname, run')} GROUP BY seqname, run, g")
def M04_merge_runs(spark, d):
    rows = bed3(spark, d).withColumn("label", F.col("rid") % 3)
    return merge.merge_runs(rows, 0, "label", [F.count(F.lit(1)).alias("n")], order=["rid"])


def _fold_sql(near: str) -> str:
    """The sequential rule by recursion: f is the group so far, r the next row."""
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY seqname ORDER BY range_start, range_end, rid) AS n FROM {BED3}),
 f AS (SELECT seqname, n, range_start AS first_start, range_end AS group_end, 1 AS g FROM r WHERE n = 1
  UNION ALL SELECT r.seqname, r.n, CASE WHEN {near} THEN f.first_start ELSE r.range_start END, CASE WHEN {near} THEN greatest(f.group_end, r.range_end) ELSE r.range_end END, CASE WHEN {near} THEN f.g ELSE f.g + 1 END
  FROM f JOIN r ON r.seqname = f.seqname AND r.n = f.n + 1)
 SELECT f.seqname, min(r.range_start) AS range_start, max(r.range_end) AS range_end, count(*) AS n FROM f JOIN r ON r.seqname = f.seqname AND r.n = f.n GROUP BY f.seqname, f.g"""


_GAP = "r.range_start - least(f.group_end, r.range_end)"


@query(_fold_sql(f"{_GAP} <= 0 AND r.range_start - f.first_start < 500"))
def M04_merge_where(spark, d):
    """An arbitrary predicate, here on the first row of the group."""
    return merge.merge_where(bed3(spark, d), 0, lambda first, row: row[START] - first[START] < 500, [F.count(F.lit(1)).alias("n")], order=["rid"])


@query(_fold_sql(f"{_GAP} <= -5"))
def M01_merge_overlap(spark, d):
    """Negative distance: at least 5 shared positions."""
    return merge.merge(bed3(spark, d), -5, [F.count(F.lit(1)).alias("n")], order=["rid"])


@query(f"SELECT seqname, min(range_start) AS range_start, max(range_end) AS range_end, string_agg(name, ',' ORDER BY range_start, range_end, rid) AS names FROM {_islands_sql(f'(SELECT rid, seqname, range_start, range_end, coalesce(feature_name, chr(46)) AS name FROM {BED5})', 0)} GROUP BY seqname, g")
def M06_merge_bed4(spark, d):
    rows = bed5(spark, d).withColumn("name", F.coalesce("feature_name", F.lit(".")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(START, END, "rid", "name"))), lambda x: x["name"]), ",")
    return merge.merge(rows, 0, [names.alias("names")])


# ---- feature density --------------------------------------------------------------------------------------------
def _density_sql(src: str, key: str, chop: bool = False) -> str:
    return f"""SELECT l.seqname, l.range_start, l.range_end, r.{key}, sum({_W})::BIGINT AS bp FROM {_windows_sql(WINDOW, WINDOW, chop)} l JOIN {src} r ON {OV} GROUP BY ALL"""


_FEATURES = f"(SELECT rid, seqname, range_start, range_end, feature_name AS feature FROM {BED5} WHERE feature_name IS NOT NULL)"
_MERGED = f"(SELECT seqname, feature, min(range_start) AS range_start, max(range_end) AS range_end FROM {_islands_sql(_FEATURES, 0, 'seqname, feature')} GROUP BY seqname, feature, g)"


@query(_density_sql(_MERGED, "feature"))
def F01_feature_density(spark, d):
    return density.feature_density(bed5(spark, d), seqlens(spark, d), WINDOW)


_K3 = f"(SELECT rid, seqname, range_start, range_end, 'k' || (rid % 3) AS feature FROM {BED3})"
_SETS = f"(SELECT l.seqname, l.range_start, l.range_end, string_agg(DISTINCT r.feature, ',' ORDER BY r.feature) AS feature_set FROM {_SEGMENTS} l JOIN {_K3} r ON {OV} GROUP BY ALL)"


def _k3(spark, d):
    return bed3(spark, d).withColumn("feature_name", F.concat(F.lit("k"), (F.col("rid") % 3).cast("string")))


@query(_density_sql(_SETS, "feature_set", True))
def F02_feature_density_exclusive(spark, d):
    return density.feature_density_exclusive(_k3(spark, d), seqlens(spark, d), WINDOW, chop=True)


_SETS5 = f"(SELECT l.seqname, l.range_start, l.range_end, string_agg(DISTINCT r.feature, ',' ORDER BY r.feature) AS feature_set FROM {_SEGMENTS.replace(BED3, _FEATURES)} l JOIN {_MERGED} r ON {OV} GROUP BY ALL)"


@query(_density_sql(_SETS5, "feature_set"))
def F02_feature_density_exclusive_bed5(spark, d):
    """By the features themselves, over all rows that name one."""
    return density.feature_density_exclusive(bed5(spark, d), seqlens(spark, d), WINDOW)


_KMERGED = f"(SELECT seqname, feature, min(range_start) AS range_start, max(range_end) AS range_end FROM {_islands_sql(_K3, 0, 'seqname, feature')} GROUP BY seqname, feature, g)"


@query(f"SELECT w.seqname, w.range_start, w.range_end, {', '.join(f'''coalesce(max(bp) FILTER (feature = 'k{i}'), 0)::BIGINT AS k{i}''' for i in range(3))} FROM {_windows_sql(WINDOW, WINDOW)} w LEFT JOIN ({_density_sql(_KMERGED, 'feature')}) x ON w.seqname = x.seqname AND w.range_start = x.range_start GROUP BY ALL")
def F03_density_matrix(spark, d):
    s = seqlens(spark, d)
    long = density.feature_density(_k3(spark, d), s, WINDOW)
    return density.matrix(long, s, WINDOW, None, False, "feature", ["k0", "k1", "k2"])


@query(f"SELECT feature, sum(bp)::BIGINT AS total_bp FROM ({_density_sql(_MERGED, 'feature')}) GROUP BY feature")
def A11_column_totals(spark, d):
    return density.column_totals(density.feature_density(bed5(spark, d), seqlens(spark, d), WINDOW), "feature")


# ---- order, dictionary, access ----------------------------------------------------------------------------------
@query(f"SELECT rid, row_number() OVER (ORDER BY s.ord, l.seqname, range_start, range_end, rid) - 1 AS position FROM {BED3} l JOIN {SEQLENS} s ON l.seqname = s.seqname")
def O01_sort(spark, d):
    s = seqlens(spark, d).select(F.col(SEQ).alias("_k"), "ord")
    rows = lookup_join(bed3(spark, d), s, [SEQ], ["_k"], "inner", "rid")
    return ordering.with_position(rows, ["ord", SEQ, START, END, "rid"]).select("rid", "position")


_NATURAL = "regexp_replace(regexp_replace(l.seqname, '([0-9]+)', '000000000000000000\\1', 'g'), '0*([0-9]{18})($|[^0-9])', '\\1\\2', 'g')"


@query(f"SELECT rid, row_number() OVER (ORDER BY s.ord IS NULL, s.ord, {_NATURAL}, range_start, range_end, rid) - 1 AS position FROM {BED3} l LEFT JOIN {SEQLENS} s ON l.seqname = s.seqname")
def O01_sort_all(spark, d):
    """Position of every range in the order of sort_ranges: names outside the genome come at the end."""
    return ordering.range_positions(bed3(spark, d), seqlens(spark, d), "rid").select("rid", "position")


@query(f"SELECT feature_name, row_number() OVER (ORDER BY min(rid), feature_name) - 1 AS code FROM {BED5} WHERE feature_name IS NOT NULL GROUP BY feature_name")
def O02_dictionary(spark, d):
    return ordering.dictionary(bed5(spark, d), "feature_name", "rid")


@query(f"SELECT seqname, count(*) AS n, min(range_start) AS first_start, max(range_end) AS last_end FROM {BED3} GROUP BY seqname")
def O05_ranges_by_sequence(spark, d):
    return ordering.ranges_by_sequence(bed3(spark, d))


@query(f"SELECT seqname, string_agg(rid::VARCHAR, ',' ORDER BY range_start, range_end, rid) AS rids FROM {BED3} GROUP BY seqname")
def O07_data_by_seqname(spark, d):
    out = frame(spark, d).data_by_seqname("rid")
    return out.select(SEQ, F.array_join("rid", ",").alias("rids"))


# ---- per-position data ------------------------------------------------------------------------------------------
def _texts(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias(SEQ), "doc_id", "text").where("text IS NOT NULL")


CHUNK = 256
_REGIONS = "(SELECT doc_id, text, 7::BIGINT AS lo, length(text)::BIGINT - 5 AS hi FROM documents WHERE length(text) > 20)"


def _regions(spark, d):
    t = _texts(spark, d).where(F.length("text") > 20)
    return t.select(F.col("doc_id").alias("rid"), SEQ, F.lit(7).cast("long").alias(START), (F.length("text") - 5).cast("long").alias(END))


@query("SELECT 'd' || doc_id AS seqname, length(text)::BIGINT AS seq_length FROM documents WHERE length(text) > 0")
def Q01_sequence_lengths(spark, d):
    return sequences.sequence_lengths(sequences.chunk_text(_texts(spark, d), "text", CHUNK))


@query(f"SELECT doc_id AS rid, md5(substring(text, lo + 1, hi - lo)) AS slice_md5 FROM {_REGIONS}")
def Q03_region_slices(spark, d):
    chunks = sequences.chunk_text(_texts(spark, d), "text", CHUNK)
    return sequences.region_map(_regions(spark, d), chunks, lambda s: F.md5(s), "slice_md5", chunk=CHUNK).select("rid", "slice_md5")


def _gc_sql(num: str, den: str) -> str:
    return f"SELECT doc_id AS rid, round(CASE WHEN {den} = 0 THEN 0 ELSE {num} / {den} END, 9) AS gc FROM (SELECT doc_id, regexp_replace(substring(text, lo + 1, hi - lo), '[^\\x00-\\x7f]', '?', 'g') AS s FROM {_REGIONS})"


def _count_sql(letters: str) -> str:
    return f"length(regexp_replace(upper(s), '[^{letters}]', '', 'g'))::DOUBLE"


def _gc(spark, d, f):
    t = _texts(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", "?"))
    return sequences.region_map(_regions(spark, d), sequences.chunk_text(t, "text", CHUNK), lambda s: F.round(f(s), 9), "gc", chunk=CHUNK).select("rid", "gc")


@query(_gc_sql(_count_sql("GCSVHDBN"), "length(s)::DOUBLE"))
def Q04_gc_content(spark, d):
    return _gc(spark, d, N.gc_content)


@query(_gc_sql(_count_sql("GC"), _count_sql("ATGC")))
def Q05_gc_content_strict(spark, d):
    return _gc(spark, d, N.gc_content_strict)


@query("SELECT vec_id AS rid, round(list_sum(list_transform(embedding[4:20], lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def Q02_numeric_slices(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias(SEQ), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ranges = e.select(F.col("vec_id").alias("rid"), SEQ, F.lit(3).cast("long").alias(START), F.lit(20).cast("long").alias(END))
    total = lambda s: F.round(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), 6)
    return sequences.region_map(ranges, sequences.chunk_array(e, "v", 16), total, "total", chunk=16).select("rid", "total")


@query(f"SELECT rid, coalesce(CASE WHEN isfinite(score) THEN score END, 0) + 1 AS x FROM {BED5}")
def N01_array1(spark, d):
    x = F.coalesce(F.when(A.finite(F.col("score")), F.col("score")), F.lit(0.0)) + 1
    return sequences.into_array(bed5(spark, d), [x], "v", 1).select("rid", sequences.array_value("v", 0).alias("x"))


@query(f"SELECT 0::BIGINT AS position, sum(range_end - range_start)::DOUBLE AS total FROM {BED5} UNION ALL SELECT 1, count(*)::DOUBLE FROM {BED5}")
def N02_array2_column_sums(spark, d):
    rows = sequences.into_array(bed5(spark, d), [F.col(END) - F.col(START), F.lit(1)], "v", 2)
    return sequences.column_sums(rows, "v", 2).select(F.col("position").cast("long").alias("position"), "total")


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[3]::DOUBLE AS third, embedding[9999]::DOUBLE AS outside FROM embeddings")
def N04_indexed_access(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", sequences.array_value("v", 0).alias("first"), sequences.array_value("v", 2).alias("third"), sequences.array_value("v", 9998).alias("outside"))

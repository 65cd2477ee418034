"""Random ranges for tests and benchmarks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import END, LENGTH, SEQ, START

SEED = int(os.environ.get("TEST_SEED", "13"))
SHORTEST, LONGEST = 1, 1000


def random_ranges(spark: SparkSession, seqlens: DataFrame, n: int, seed: int = SEED, scores: bool = False) -> DataFrame:
    """n ranges: uniform sequence, width in [1, 1000) or the whole of a shorter sequence, uniform start; with an 8-letter
    name and a U(0, 1) score.  Sequences of one position are not drawn; a genome without others gives no rows."""
    names = F.broadcast(seqlens.where(F.col(LENGTH) > SHORTEST).agg(F.array_sort(F.collect_list(F.struct("ord", SEQ, LENGTH))).alias("_g")))
    rows = spark.range(n).crossJoin(names).withColumn("_s", F.get("_g", F.floor(F.rand(seed) * F.size("_g")).cast("int")))  # names: one row
    rows = rows.where("_s IS NOT NULL")
    wide = F.lit(SHORTEST) + F.floor(F.rand(seed + 1) * (LONGEST - SHORTEST))
    rows = rows.withColumn("_w", F.least(wide, F.col(f"_s.{LENGTH}")).cast("long"))
    rows = rows.withColumn(START, F.floor(F.rand(seed + 2) * (F.col(f"_s.{LENGTH}") - F.col("_w"))).cast("long"))
    cols = [F.col(f"_s.{SEQ}").alias(SEQ), START, (F.col(START) + F.col("_w")).alias(END)]
    if scores:
        letters = [F.chr((F.lit(97) + F.floor(F.rand(seed + 10 + i) * 26)).cast("int")) for i in range(8)]
        cols += [F.concat(*letters).alias("feature_name"), F.rand(seed + 3).alias("score")]
    return rows.select(F.col("id").alias("rid"), *cols)

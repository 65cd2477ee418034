"""Queries p6_ to p8_ and the SQL of those that have some."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import leakage, mojibake, packing


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _items(spark, d):
    return spark.read.parquet(f"{d}/eval_items.parquet")


def p6_pack(spark, d):
    return packing.pack(_docs(spark, d))


def p6_checks(spark, d):
    """What every packing must keep: documents assigned once, none split that fits, no container over its capacity."""
    packed = packing.pack(_docs(spark, d))
    per_doc = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.countDistinct("piece").alias("distinct_pieces"), F.max("n_tokens").alias("largest"))
    ok = (F.col("pieces") == F.col("distinct_pieces")) & ((F.col("pieces") == 1) | (F.col("tokens") > packing.CAPACITY)) & (F.col("largest") <= packing.CAPACITY)
    docs = per_doc.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("wrong_documents"))
    return docs.crossJoin(F.broadcast(packing.utilisation(packed).select(F.col("overfull").cast("long").alias("overfull_containers"))))  # one row each


P6_CHECKS = "SELECT count(*) AS documents, 0::BIGINT AS wrong_documents, 0::BIGINT AS overfull_containers FROM documents"


def p6_utilisation(spark, d):
    return packing.utilisation(packing.pack(_docs(spark, d)))


def p7_found(spark, d):
    return leakage.find_leaks(_docs(spark, d), _items(spark, d))


def p7_items(spark, d):
    """Test items that leaked, with the number of documents that hold them."""
    items = _items(spark, d).select("item_id", "suite", "lang")
    leaks = leakage.find_leaks(_docs(spark, d), _items(spark, d)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.join(leaks, "item_id")


def p8_found(spark, d):
    return mojibake.find_garbled(_docs(spark, d))


def p8_restored(spark, d):
    return mojibake.restore(_docs(spark, d))


def p8_checks(spark, d):
    """Every test item, its letters beyond ASCII read in a wrong set, set down among the documents: found and restored?

    One row an item: whether it is found if and only if damage changed it, and whether every word came back.
    """
    items = _items(spark, d).select((-1 - F.col("item_id")).alias("doc_id"), F.col("item_text").alias("right"), F.decode(F.encode("item_text", "UTF-8"), "ISO-8859-1").alias("text"))
    restored = mojibake.restore(_docs(spark, d).unionAll(items.select("doc_id", "text"))).where("doc_id < 0").select(F.col("doc_id").alias("_d"), "restored_text")
    out = items.join(restored, items["doc_id"] == restored["_d"], "left")
    found = F.col("_d").isNotNull() == (F.col("text") != F.col("right"))
    return out.select((-1 - F.col("doc_id")).alias("item_id"), found.alias("found"), (F.coalesce("restored_text", "text") == F.col("right")).alias("restored"))


P8_CHECKS = "SELECT item_id, true AS found, true AS restored FROM eval_items WHERE item_text IS NOT NULL"

QUERIES = {f.__name__: f for f in (p6_pack, p6_checks, p6_utilisation, p7_found, p7_items, p8_found, p8_restored, p8_checks)}
SQL = {"p6_checks": P6_CHECKS, "p8_checks": P8_CHECKS}

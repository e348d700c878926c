"""Operator 10: exact deduplication, DataFrame functions only.

Group by a 128-bit content hash, keep one stable id per group, and compare the
bytes inside groups so that a hash collision never joins different texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else unchanged; lower() is exact and fast where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(
    spark: SparkSession, docs: DataFrame, keep: str = "min", content_hash: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Two rows are equal when their texts, A-Z lowered, hold the same bytes.  The
    smallest (keep="min") or largest (keep="max") doc_id of a group stays.

    Rows are grouped by hash and, inside it, by the bytes; copies are combined before the
    shuffle, so one huge group costs one row a task.  What is said of a group goes back to its
    rows by its hash and the text's SHA-256, so texts move once.

    Nulls: a null text equals the empty text; a null doc_id counts in its group
    and stays only if the group has no other.  Rows repeated under one doc_id
    all count, and share `kept`.  An empty table gives no rows.  Other columns
    are not read.
    """
    hashed = content_hash or (lambda c: F.unhex(F.md5(c.cast("binary"))))
    pick = {"min": F.min, "max": F.max}[keep]
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    digest = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))

    # Groups of equal bytes; only those of several rows say anything that a row doesn't know itself.
    alike = texts.groupBy(hashed(F.col("norm")).alias("gh"), "norm").agg(F.count("*").alias("n"), pick("doc_id").alias("rep"))
    groups = stored(spark, alike.where("n > 1").select("gh", digest.alias("gsha"), "n", "rep"), "dedup-groups")

    sig = texts.select("doc_id", hashed(F.col("norm")).alias("h"), digest.alias("sha"))
    found = sig.join(groups, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha")), "left")
    size, stays = F.coalesce("n", F.lit(1)), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("rep"))
    return found.select(
        "doc_id",
        stays.alias("keep_id"),
        size.cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(stays).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

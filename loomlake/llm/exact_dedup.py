"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after each run of blanks, tabs and line ends
(`[\\x20\\x09-\\x0D]+`) became one space. Equal texts are combined in three stages, and every
stage groups by digest and whole text, so texts that only share a digest stay apart:

1. rows of one task, by Spark's map-side aggregation (no row leaves its task before that);
2. groups of one salt (a hash of the id): a text that a third of all rows share reaches each
   of `salts` groups as at most one row from each map task;
3. the winners of the salts, at most `salts` rows for each text.

Only one row for each distinct text of a task is shuffled, never all copies. Rows find their
group's winner again by digest, through a join whose wide side carries ids and digests only and in which
large groups are dealt over many tasks (`common.spread_join`); digests that stand for more than one text, which stage 3 would reveal, are matched by whole text.

Defined cases: a very long text is compared whole; null text counts as empty; empty and blank-only texts form groups like others
(a blank-only text equals another one, but not the empty text); rows that repeat an id and a
text all count in `group_size` and share `kept`; rows without an id never win against rows that
have one, and a group of such rows has a null `keep_id` and keeps them all; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, spread_join, stored, text_of

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), BLANKS, " ")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row for each distinct normalised text: digest, content, keep_id, group_size."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        normalised(text_col).alias("content"),
    ).select("id", "content", F.sha2("content", 256).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("salt", "digest", "content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`."""
    spark = docs.sparkSession
    won = winners(docs, id_col, text_col, salts)
    groups = stored(
        won.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
        shared_dir(spark),
        "groups",
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("digest"))
    found = spread_join(rows, groups.filter("texts = 1").drop("texts"), "digest", "group_size", ["doc_id"])
    shared = groups.filter("texts > 1").select("digest")
    if not shared.isEmpty():
        full = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("content")).withColumn("digest", F.sha2("content", 256))
        exact = full.join(shared, "digest", "left_semi").join(won, ["digest", "content"]).drop("content")
        found = found.unionByName(exact)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )

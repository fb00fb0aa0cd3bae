"""Text search by trigrams: postings of each collection narrow a search down to candidates, which `contains` confirms.

    write(records, path)
    search(records, spark, path, "licensed", "app.fixture.doc")

A text that holds the query holds all its trigrams, so the rarest of them, with the shortest postings, are enough to find candidates. Postings lie in a folder for each
collection and slot (a hash of the trigram), sorted by trigram, so a search reads a few slots' row groups and the candidates' records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTINGS = "gram string, uri string, collection string, slot int"
COUNTS = "gram string, n long, collection string"
SLOTS, RAREST, LEAST = 64, 3, 3


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def slot_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def dealt(records: DataFrame) -> DataFrame:
    """Records dealt over tasks by uri, as a text makes hundreds of postings and a file may be read by one task."""
    spark = records.sparkSession
    return records.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "uri")


def write(records: DataFrame, path: str) -> None:
    """Postings and how many each trigram has. A trigram that nearly all records have is split over files of its slot."""
    postings = dealt(records.select("uri", "collection", "json")).select("uri", "collection", F.explode(trigrams(F.col("json"))).alias("gram")).withColumn("slot", slot_of(F.col("gram")))
    postings.hint("rebalance", "collection", "slot").sortWithinPartitions("collection", "slot", "gram").write.mode("overwrite").partitionBy("collection", "slot").parquet(f"{path}/postings")
    found = records.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings")
    found.groupBy("collection", "gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("collection").parquet(f"{path}/counts")


def rarest(spark: SparkSession, path: str, text: str, collection: str | None = None, most: int = RAREST) -> list[tuple[str, int]] | None:
    """(trigram, slot) of the query's rarest trigrams; None if one occurs nowhere. At most as many rows as the query has letters are collected."""
    grams = spark.range(1).select(F.explode(trigrams(F.lit(text))).alias("gram")).withColumn("slot", slot_of(F.col("gram")))
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
    counts = counts.filter(F.col("collection") == collection) if collection else counts
    asked = [(r["gram"], r["slot"]) for r in grams.collect()]
    held = {r["gram"]: r["n"] for r in counts.filter(F.col("gram").isin([g for g, _ in asked])).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    if any(g not in held for g, _ in asked):
        return None
    return sorted(asked, key=lambda x: (held[x[0]], x[0]))[:most]


def candidates(spark: SparkSession, path: str, grams: list[tuple[str, int]], collection: str | None = None) -> DataFrame:
    """uri of the records that have all of some trigrams."""
    found = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    found = found.filter(F.col("collection") == collection) if collection else found
    wanted = reduce(Column.__or__, [(F.col("slot") == slot) & (F.col("gram") == gram) for gram, slot in grams])
    return found.filter(F.col("slot").isin(sorted({s for _, s in grams})) & wanted).groupBy("uri").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("uri")


def search(records: DataFrame, path: str, text: str, collection: str | None = None) -> DataFrame:
    """The rows that `filters.search` finds, by the index of these records at `path`."""
    if len(text) < LEAST:
        raise ValueError("search for at least three characters")
    spark = records.sparkSession
    found = records.filter(F.col("collection") == collection) if collection else records
    grams = rarest(spark, path, text, collection)
    if grams is None:
        return found.limit(0)
    return found.join(candidates(spark, path, grams, collection), "uri", "left_semi").filter(F.contains(F.lower("json"), F.lower(F.lit(text))))

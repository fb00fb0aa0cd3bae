"""Counts of records by collection and day, kept from changes, and sketches of their authors.

A change carries the day that its record leaves and the day it comes to (`keyed.CHANGES`), so a batch adds signed counts and nothing is counted again. Sketches of authors
can be united but not shrunk: they tell who has ever had a record there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

#: 2**12 registers: a relative standard error of 1.04 / 64, about 1.6 %.
REGISTERS_LOG2 = 12
ERROR = 1.04 / 2 ** (REGISTERS_LOG2 / 2)


def deltas(changes: DataFrame) -> DataFrame:
    """collection, day, delta, authors (a sketch) of a batch of changes; a collection with most rows is summed where the rows lie first."""
    came = changes.filter("new_day is not null").select("collection", F.col("new_day").alias("day"), F.lit(1).alias("delta"), "did")
    left = changes.filter("old_day is not null").select("collection", F.col("old_day").alias("day"), F.lit(-1).alias("delta"), F.lit(None).cast("string").alias("did"))
    return came.unionByName(left).groupBy("collection", "day").agg(F.sum("delta").alias("delta"), F.hll_sketch_agg("did", F.lit(REGISTERS_LOG2)).alias("authors"))


def keep(changes: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Add each batch's deltas to `path`; a batch that is run again replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        deltas(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def by_day(spark: SparkSession, path: str) -> DataFrame:
    """collection, date, count, authors: days that have records now, and about how many authors ever had one there."""
    rows = spark.read.parquet(path).groupBy("collection", "day").agg(F.sum("delta").alias("count"), F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("authors"))
    return rows.filter("count <> 0").select("collection", F.col("day").alias("date"), "count", "authors")


def by_collection(spark: SparkSession, path: str) -> DataFrame:
    """collection, count, authors, from the same rows: sketches of days are united."""
    return spark.read.parquet(path).groupBy("collection").agg(F.sum("delta").alias("count"), F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("authors"))


def time_series(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """date, count, cumulative of all collections or one."""
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("collection") == collection) if collection else rows
    days = rows.groupBy(F.col("day").alias("date")).agg(F.sum("delta").alias("count")).filter("count <> 0")
    return days.withColumn("cumulative", F.sum("count").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each day

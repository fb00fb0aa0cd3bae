"""The activity log, in a folder for each day, so that old days go without reading or rewriting a row."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import RETENTION_DAYS
from .record_store import folders, remove


def append(activity: DataFrame, path: str, batch: int) -> None:
    """Add the rows of one batch; the same batch again replaces its own rows. Days are those of the session's time zone."""
    dated = activity.withColumn("day", F.to_date("timestamp")).withColumn("batch", F.lit(batch).cast("long"))
    dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def read(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The log, or what lies between two times; only folders of their days are read."""
    found = spark.read.parquet(path)
    for at, after in ((since, True), (until, False)):
        if at is not None:
            day, ts = F.col("day"), F.col("timestamp")
            found = found.filter((day >= F.lit(at.date())) & (ts >= F.lit(at)) if after else (day <= F.lit(at.date())) & (ts <= F.lit(at)))
    return found.drop("day", "batch")


def drop_old_days(spark: SparkSession, path: str, as_of: datetime, days: int = RETENTION_DAYS) -> list[str]:
    """Delete the folders of days that end before the retention's start; the days are returned."""
    first = (as_of - timedelta(days=days)).date()
    old = [d for d in folders(spark, path, "day") if d != "__HIVE_DEFAULT_PARTITION__" and date.fromisoformat(d) < first]
    for d in old:
        remove(spark, f"{path}/day={d}")
    return old


def retained(spark: SparkSession, path: str, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """What the retention keeps: old days are gone, and of the first day only what is young enough is shown."""
    drop_old_days(spark, path, as_of, days)
    return read(spark, path, since=as_of - timedelta(days=days))

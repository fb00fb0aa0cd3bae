"""Counts, time series and the activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json_values import text_at
from ..functions.times import day_of, extracted_created_at, normalised_created_at
from ..functions.uris import is_valid_did

# Ranges of the activity chart, hours and minutes of a bucket.
ACTIVITY_RANGES = {"ONE_HOUR": (1, 5), "THREE_HOURS": (3, 15), "SIX_HOURS": (6, 30), "ONE_DAY": (24, 60), "SEVEN_DAYS": (168, 1440)}
RETENTION_DAYS = 7


def table_counts(records: DataFrame, actors: DataFrame, lexicons: DataFrame | int = 0) -> DataFrame:
    """One row: how many records, actors and lexicons (a table of them, or how many a catalogue has)."""
    one = records.agg(F.count(F.lit(1)).alias("record_count"))
    two = actors.agg(F.count(F.lit(1)).alias("actor_count"))
    both = one.crossJoin(F.broadcast(two))  # one row each
    if isinstance(lexicons, DataFrame):
        return both.crossJoin(F.broadcast(lexicons.agg(F.count(F.lit(1)).alias("lexicon_count"))))
    return both.withColumn("lexicon_count", F.lit(lexicons).cast("long"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def collection_stats(records: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """Records of each collection, the largest first; an empty list means all."""
    found = records.filter(F.col("collection").isin(collections)) if collections else records
    return count_by(found, "collection").orderBy(F.col("count").desc(), "collection")


def record_day(json: Column | str, indexed_at: Column | str) -> Column:
    """A record's day: that of createdAt, else of eventDate, else when it was indexed."""
    return F.coalesce(day_of(text_at(json, "createdAt")), day_of(text_at(json, "eventDate")), F.to_date(indexed_at))


def collection_time_series(records: DataFrame, collection: str | None = None) -> DataFrame:
    """date, count, cumulative, total_records, unique_users; a day is that of createdAt, else eventDate, else indexed_at."""
    found = records.filter(F.col("collection") == collection) if collection else records
    day = record_day("json", "indexed_at")
    days = found.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("count"))
    totals = found.agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct("did").alias("unique_users"))
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    return days.withColumn("cumulative", F.sum("count").over(running)).crossJoin(F.broadcast(totals))  # one row


def activity_buckets(activity: DataFrame, name: str, as_of: Column, day: bool = False) -> DataFrame:
    """Operations by bucket over a range's last hours. The seven-day range has hourly buckets, or days with `day`."""
    hours, minutes = ACTIVITY_RANGES[name]
    ts = F.col("timestamp")
    within = F.make_dt_interval(F.lit(0), F.lit(0), (F.lit(minutes) * F.floor(F.minute(ts) / F.lit(minutes))).cast("int"))
    bucket = F.date_trunc("DAY", ts) if day else F.date_trunc("HOUR", ts) + within
    n = lambda op: F.count_if(F.col("operation") == op)
    return (
        activity.filter((ts >= as_of - F.expr(f"interval {hours} hours")) & (ts <= as_of))
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("total"), n("create").alias("creates"), n("update").alias("updates"), n("delete").alias("deletes"))
        .withColumn("changes", F.col("creates") + F.col("updates") + F.col("deletes"))
    )


def recent_activity(activity: DataFrame, hours: int, as_of: Column, most: int = 1000) -> DataFrame:
    found = activity.filter(F.col("timestamp") >= as_of - F.expr(f"interval {hours} hours"))
    return found.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(min(most, 1000))


def retained(activity: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return activity.filter(F.col("timestamp") >= as_of - F.expr(f"interval {days} days"))


def logged(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected): blank or null event JSON becomes {}, invalid JSON is rejected."""
    text = F.trim(F.coalesce("event_json", F.lit("")))
    fixed = entries.withColumn("event_json", F.when(text.isin("", "null"), "{}").otherwise(F.col("event_json")))
    good = F.try_parse_json("event_json").isNotNull()
    return fixed.filter(good), fixed.filter(~good)


def with_latest_status(activity: DataFrame, updates: DataFrame) -> DataFrame:
    """Activity with the newest of its status updates (id, status, error_message, ts)."""
    last = updates.groupBy("id").agg(F.max_by(F.struct("status", "error_message"), "ts").alias("new"))
    return activity.join(last, "id", "left").select(
        *[c for c in activity.columns if c not in ("status", "error_message")],
        F.coalesce("new.status", "status").alias("status"),
        F.when(F.col("new").isNotNull(), F.col("new.error_message")).otherwise(F.col("error_message")).alias("error_message"),
    )


def rebuilt_activity(records: DataFrame) -> DataFrame:
    """One successful create for each record, at its created-at time or else when it was indexed."""
    return records.select(
        extracted_created_at("json", F.col("indexed_at")).alias("timestamp"), F.lit("create").alias("operation"), "collection", "did", "rkey",
        F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("json").alias("event_json"),
    )


def backfilled_created_at(records: DataFrame) -> DataFrame:
    return records.withColumn("record_created_at", F.coalesce("record_created_at", normalised_created_at("json")))


def purge_preview(records: DataFrame, actors: DataFrame, did: str) -> DataFrame:
    """One row: is the DID valid, is there such an actor, how many records would go."""
    n = records.filter(F.col("did") == did).agg(F.count(F.lit(1)).alias("record_count"))
    known = actors.filter(F.col("did") == did).agg((F.count(F.lit(1)) > 0).alias("actor_exists"))
    return n.crossJoin(F.broadcast(known)).select(F.lit(did).alias("did"), is_valid_did(F.lit(did)).alias("valid"), "actor_exists", "record_count")  # one row each


def ingestion_counters(events: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """One row: received, created, updated, deleted and identity events. Works on streams in complete mode.

    With `quarantine`, the messages that couldn't be read, also `errors`; they count as received.
    """
    if quarantine is not None:
        failed = quarantine.select(F.lit("error").alias("kind"), F.lit(None).cast("string").alias("action"))
        both = events.select("kind", "action").unionByName(failed)
        return ingestion_counters(both).crossJoin(F.broadcast(both.agg(F.count_if(F.col("kind") == "error").alias("errors"))))  # one row each
    n = F.count_if
    record = F.col("kind") == "record"
    return events.agg(
        F.count(F.lit(1)).alias("received"), n(record & (F.col("action") == "create")).alias("created"), n(record & (F.col("action") == "update")).alias("updated"),
        n(record & (F.col("action") == "delete")).alias("deleted"), n(F.col("kind") == "identity").alias("identity"),
    )


def aggregate(records: DataFrame, group_by: list[Column], interval: str | None = None, at: str = "indexed_at") -> DataFrame:
    """Counts by any expressions and, with `interval` (HOUR, DAY, WEEK, MONTH), by time."""
    keys = list(group_by) + ([F.date_trunc(interval, at).alias("interval_start")] if interval else [])
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("did").alias("unique_users"))

"""Raw feeds as a stream, and what follows from the outcomes of change events: change feed, activity, live counts.

`outcomes` are rows of `keyed.record_changes`, or of `applied` for a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.json_values import variant_of
from ..functions.uris import record_uri
from ..operators.records import is_purge
from ..operators.typed import fields_of
from ..sources.lexicons import Catalogue


def applied(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Record events with `outcome`: created, updated, skipped (equal content), deleted, ignored (no body)."""
    purges = events.filter(is_purge()).groupBy("did").agg(F.collect_list("seq").alias("purges"))
    records = events.filter(F.col("kind") == "record").withColumn("uri", record_uri("did", "collection", "rkey"))
    old = snapshot.join(records.select("uri").distinct(), "uri", "left_semi").select(
        "did", "uri", F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("action"), "cid", F.col("json").alias("body")
    )
    upsert = F.col("action").isin("create", "update") & F.col("body").isNotNull()
    rows = records.unionByName(old, allowMissingColumns=True).join(purges, "did", "left")
    counts = F.when(upsert | (F.col("action") == "delete"), F.struct("seq", "action", "cid"))
    before = F.last(counts, ignorenulls=True).over(Window.partitionBy("uri").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prev", before)
    purged = F.coalesce(F.exists("purges", lambda p: (p > F.col("prev.seq")) & (p < F.col("seq"))), F.lit(False))
    stored = F.col("prev").isNotNull() & (F.col("prev.action") != "delete") & ~purged
    same = stored & (F.coalesce("cid", F.lit("")) != "") & (F.col("prev.cid") == F.col("cid"))
    outcome = F.when(F.col("action") == "delete", "deleted").when(~upsert, "ignored").when(same, "skipped").when(stored, "updated").otherwise("created")
    return rows.withColumn("outcome", outcome).filter("seq >= 0").drop("prev", "purges")


def feed(outcomes: DataFrame, collection: str | None = None, publish_skipped: bool = False) -> DataFrame:
    """The change feed: type, uri, cid, did, collection, record (null when deleted, else with uri and cid inside)."""
    shown = ["created", "updated", "deleted"] + ["skipped"] * publish_skipped
    rows = outcomes.filter(F.col("outcome").isin(shown))
    if collection:
        rows = rows.filter(F.col("collection") == collection)
    inner = F.concat(F.lit('{"uri":'), quoted("uri"), F.lit(',"cid":'), quoted("cid"), F.when(F.col("body") == "{}", "}").otherwise(F.concat(F.lit(","), F.substring("body", 2, 1 << 30))))
    body = F.when(variant_of("body").isNotNull() & F.col("body").startswith("{"), inner).otherwise(F.col("body"))
    return rows.select("seq", F.col("action").alias("type"), "uri", "cid", "did", "collection", F.when(F.col("outcome") != "deleted", body).alias("record"))


def typed_feed(rows: DataFrame, catalogue: Catalogue, nsid: str) -> DataFrame:
    """The feed of one collection with `record` as a struct by its lexicon, missing required fields filled; null when deleted."""
    parsed = rows.filter(F.col("collection") == nsid).withColumn("s", F.from_json("record", catalogue.schema(nsid, raw=True)))
    record = F.when(F.col("s").isNotNull(), F.struct(*fields_of(F.col("s"), catalogue, nsid)))
    return parsed.select("seq", "type", "uri", "cid", "did", "collection", record.alias("record"))


def quoted(column: str):
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(column, F.lit("")).alias("x"))), r'^\{"x":(.*)\}$', 1)


def activity_of(outcomes: DataFrame, status: str = "completed", log_skipped: bool = False) -> DataFrame:
    """Log rows of a batch. The commit feed logs skipped events too, with status 'success'."""
    shown = ["created", "updated", "deleted"] + ["skipped"] * log_skipped
    return outcomes.filter(F.col("outcome").isin(shown)).select(
        F.col("ts").alias("timestamp"), F.col("action").alias("operation"), "collection", "did", "rkey", F.lit(status).alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.coalesce("body", F.lit("{}")).alias("event_json"),
    )


def ingest_feed(raw: DataFrame, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep `path`/events and `path`/quarantine up to date with a stream of raw feed rows (value, arrived).

    read: `change_events.envelopes` or `commits`. Both tables come from one reading of a batch, and times from the source, so a batch that is run again writes the same rows in place
    of its own.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, rows in zip(("events", "quarantine"), read(batch), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def counters(events: DataFrame) -> DataFrame:
    """Live counts by kind and action, for update or complete mode."""
    return events.groupBy("kind", F.coalesce("action", F.lit("")).alias("action")).agg(F.count(F.lit(1)).alias("count"))


def bucket_counts(activity: DataFrame, minutes: int, late: str = "7 days") -> DataFrame:
    """Activity by tumbling windows; events later than `late` are left out and old windows are closed."""
    n = lambda op: F.count_if(F.col("operation") == op)
    return (
        activity.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", f"{minutes} minutes"))
        .agg(F.count(F.lit(1)).alias("total"), n("create").alias("creates"), n("update").alias("updates"), n("delete").alias("deletes"))
        .select(F.col("window.start").alias("bucket"), "total", "creates", "updates", "deletes")
    )

"""Label subscriptions as a stream of frames: an append-only log of labels, and what is known of each subscription.

A frame is of one subscription: labels (a row for each, all of an event in one batch), connected, error or info. `arrived` orders the frames.

* An event with a bad label stores nothing and holds the cursor: later events wait until the event comes again without fault.
* A fatal frame ends a subscription: from then on nothing is stored and no time or cursor moves.
* Events up to the cursor have been stored before; when they come again nothing is added.

The log is dealt by rows, never by subscription: only one row for each event, then one for each subscription, is grouped, with partial sums first.
The state of all subscriptions (a row for each) is written anew with each batch, so a batch that is run again starts from the same
state and replaces its own files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import KEY, frame_events

STATE = "subscription_url string, last_seq long, last_event_at timestamp, last_connected_at timestamp, error string, fatal string, held_seq long"
LABEL = ["src", "uri", "cid", "val", "neg", "cts", "exp"]
#: What is said of an event that is rejected; the reason comes after it.
REJECTED = "persist labeler labels seq="


def state_before(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The newest state, or the newest before a batch; none before the first."""
    try:
        states = spark.read.schema(STATE + ", batch long").parquet(f"{path}/subscriptions")
    except AnalysisException:
        return spark.createDataFrame([], STATE)
    if batch is not None:
        states = states.filter(F.col("batch") < batch)
    newest = states.agg(F.max("batch")).first()[0]
    return states.filter(F.col("batch") == (-1 if newest is None else newest)).drop("batch")


def folded(frames: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels to store, state afterwards) of a batch of frames."""
    url = "subscription_url"
    other = frame_events(frames.filter("op <> 'labels'").select(url, "op", "name", "message", "ts", F.col("arrived").alias("seq"))).select(url, "kind", "message", "ts", F.col("seq").alias("arrived"))
    ended = other.groupBy(url).agg(F.min(F.when(F.col("kind") == "fatal", F.col("arrived"))).alias("ended"), F.max_by(F.when(F.col("kind") == "fatal", F.col("message")), F.when(F.col("kind") == "fatal", F.col("arrived"))).alias("new_fatal"))
    known = frames.select(url).distinct().join(state, url, "full").join(ended, url, "left")
    known = known.withColumn("ended", F.when(F.col("fatal").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("ended")))
    live = F.col("ended").isNull() | (F.col("arrived") < F.col("ended"))

    # A row for each event: its first arrival without fault, and its first with one.
    each = frames.filter("op = 'labels'").groupBy(url, "seq", "arrived").agg(F.min("valid").alias("valid"), F.min("ts").alias("ts"))
    good = lambda c: F.when(F.col("valid"), F.col(c))
    events = (
        each.join(known.select(url, "ended", "last_seq", "held_seq"), url)
        .filter(live)
        .groupBy(url, "seq")
        .agg(F.min(good("arrived")).alias("good_at"), F.max(good("arrived")).alias("last_good_at"), F.min_by("ts", good("arrived")).alias("ts"), F.min(F.when(~F.col("valid"), F.col("arrived"))).alias("bad_at"), F.first("last_seq").alias("last_seq"), F.first("held_seq").alias("held_seq"))
    )
    fresh = F.col("seq") > F.coalesce("last_seq", F.lit(-1))
    bad = events.filter(fresh & F.col("good_at").isNull()).groupBy(url).agg(F.min("seq").alias("bad_seq"), F.min_by("bad_at", "seq").alias("bad_seen"))
    released = events.filter((F.col("seq") == F.col("held_seq")) & F.col("good_at").isNotNull()).select(url, F.lit(True).alias("released"))
    stops = known.join(bad, url, "left").join(released, url, "left")
    still = F.when(F.col("released").isNull(), F.col("held_seq"))
    stops = stops.withColumn("stop", F.least(still, F.col("bad_seq")))
    passed = events.filter(F.col("good_at").isNotNull()).drop("last_seq", "held_seq").join(stops.select(url, "last_seq", "stop"), url).filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop")))
    new = passed.filter(fresh)
    moved = new.groupBy(url).agg(F.max("seq").alias("new_seq"), F.max_by("ts", "seq").alias("new_event_at"))
    handled = passed.groupBy(url).agg(F.max("last_good_at").alias("handled_at"))

    calls = other.join(known.select(url, "ended"), url).filter(live & (F.col("kind") != "fatal")).groupBy(url).agg(
        F.max_by(F.when(F.col("kind") == "connected", F.col("ts")), F.when(F.col("kind") == "connected", F.col("arrived"))).alias("connected_ts"),
        F.max(F.when(F.col("kind") == "connected", F.col("arrived"))).alias("connected_at"),
        F.max(F.when(F.col("kind") == "error", F.col("arrived"))).alias("error_at"),
        F.max_by(F.when(F.col("kind") == "error", F.col("message")), F.when(F.col("kind") == "error", F.col("arrived"))).alias("new_error"),
    )
    s = stops.join(moved, url, "left").join(handled, url, "left").join(calls, url, "left")
    cleared = F.greatest("connected_at", "handled_at")
    held = F.when(F.col("bad_seq") == F.col("stop"), F.col("bad_seen"))
    worst = F.greatest("error_at", held)
    said = F.substring(F.when(held == worst, F.concat(F.lit(REJECTED), F.col("stop").cast("string"))).otherwise(F.col("new_error")), 1, 4096)
    error = F.when(worst.isNotNull() & (cleared.isNull() | (worst > cleared)), said).when(cleared.isNull(), F.col("error"))
    after = s.select(
        url,
        F.coalesce("new_seq", "last_seq").alias("last_seq"),
        F.coalesce("new_event_at", "last_event_at").alias("last_event_at"),
        F.coalesce("connected_ts", "last_connected_at").alias("last_connected_at"),
        error.alias("error"),
        F.coalesce("new_fatal", "fatal").alias("fatal"),
        F.col("stop").alias("held_seq"),
    )
    rows = frames.filter("op = 'labels' and label_index is not null")
    labels = rows.join(new.select(url, "seq", F.col("good_at").alias("arrived")), [url, "seq", "arrived"], "left_semi")
    stored = labels.groupBy(*KEY).agg(F.min(F.struct("arrived", "id", "ts", *LABEL)).alias("x")).select(*KEY, "x.id", *[f"x.{c}" for c in LABEL], F.col("x.ts").alias("received_at"))
    return stored, after


def follow(frames: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep `path`/labels and `path`/subscriptions up to date with a stream of frames.

    frames: subscription_url, op, name, message, ts, arrived, seq, label_index, valid, id, src, uri, cid, val, neg, cts, exp.
    """
    spark = frames.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        stored, after = folded(batch, state_before(spark, path, number))
        stored.write.mode("overwrite").parquet(f"{path}/labels/batch={number}")
        after.coalesce(1).write.mode("overwrite").parquet(f"{path}/subscriptions/batch={number}")  # a row for each subscription
        batch.unpersist()

    return frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def label_log(spark: SparkSession, path: str) -> DataFrame:
    """All stored labels, each once."""
    return spark.read.parquet(f"{path}/labels").drop("batch")

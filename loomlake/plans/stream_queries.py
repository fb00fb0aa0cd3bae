"""The streaming jobs over files: what is left after all batches equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..shared import shared_dir
from ..sources import change_events as E
from ..streaming import changes as C
from ..streaming import keyed as K
from ..streaming import subscriptions as S
from .fixtures import LABELS_AS_OF, spark_view, sql_views
from .label_queries import NTZ, as_of
from .record_queries import ACTORS as ACTORS_SQL
from .record_queries import EVENTS
from .registry import query
from .source_queries import READ, RECORD_FIELDS


def as_streams(df, folder: str, parts: int = 3, order: str = "seq"):
    """A table as a stream of files that comes in `parts` ranges of `order`: each time the same stream, with the next range's files there."""
    spark = df.sparkSession
    bounds = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    step = max(1, -(-(high - low + 1) // parts))
    for k in range(parts):
        part = df.filter((F.col(order) >= low + k * step) & (F.col(order) < low + (k + 1) * step))
        part.write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(df.schema).parquet(f"{folder}/in")


def changes(spark, sf_dir):
    """The log of record changes, from a job that is stopped and started again between ranges."""
    folder = shared_dir(spark)
    for stream in as_streams(spark_view(spark, sf_dir, "record_event"), folder):
        K.kept(K.record_changes(stream), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(K.CHANGES).parquet(f"{folder}/changes")


@query("stream_records", EVENTS + " select * from records")
def stream_records(spark, sf_dir):
    return NTZ(K.records_of(changes(spark, sf_dir)), "indexed_at", "record_created_at")


@query("stream_actors", EVENTS + ACTORS_SQL + " select did, arg_max(handle, seq) as handle, arg_max(ts, seq) as indexed_at from seen group by did")
def stream_actors(spark, sf_dir):
    folder = shared_dir(spark)
    for stream in as_streams(spark_view(spark, sf_dir, "record_event"), folder):
        K.kept(K.actor_changes(stream), f"{folder}/actors", f"{folder}/checkpoint").awaitTermination()
    return NTZ(K.actors_of(spark.read.schema(K.ACTOR_CHANGES).parquet(f"{folder}/actors")), "indexed_at")


# Each event's outcome from the event before it that counts, unless a purge lies between.
OUTCOMES = EVENTS + """,
every as (
    select 'at://' || did || '/' || collection || '/' || rkey as uri, *, (action = 'delete' or body is not null) as counts from record_event where kind = 'record'),
purges as (select did, seq as at from record_event where kind = 'identity' and lower(trim(coalesce(status, ''))) in ('deleted', 'deactivated', 'suspended', 'takendown')),
prior as (
    select *, last_value(case when counts then seq end ignore nulls) over w as prev_seq, last_value(case when counts then action end ignore nulls) over w as prev_action, last_value(case when counts then coalesce(cid, '') end ignore nulls) over w as prev_cid
    from every window w as (partition by uri order by seq rows between unbounded preceding and 1 preceding)),
outcome as (
    select *, prev_seq is not null and prev_action <> 'delete' and not exists (select 1 from purges p where p.did = prior.did and p.at > prev_seq and p.at < prior.seq) as has from prior),
shown as (select *, case when action = 'delete' then 'deleted' when not counts then 'ignored' when has and cid <> '' and prev_cid = cid then 'skipped' when has then 'updated' else 'created' end as outcome from outcome)"""


@query("stream_feed", OUTCOMES + """ select seq, action as type, uri, cid, did, collection, case when outcome <> 'deleted' then '{"uri":"' || uri || '","cid":"' || cid || '",' || body[2:] end as record
    from shown where outcome in ('created', 'updated', 'deleted')""")
def stream_feed(spark, sf_dir):
    return C.feed(changes(spark, sf_dir))


@query("stream_commit_activity", OUTCOMES + " select ts as timestamp, action as operation, collection, did, rkey, 'success' as status, coalesce(body, '{}') as event_json from shown where outcome in ('created', 'updated', 'deleted', 'skipped')")
def stream_commit_activity(spark, sf_dir):
    return NTZ(C.activity_of(changes(spark, sf_dir), "success", log_skipped=True).drop("error_message"), "timestamp")


# One pass over all frames: nothing counts from the fatal frame on, events without a faultless arrival stop their subscription, of an event's arrivals the first faultless one is stored.
FOLLOWED = sql_views("label_frame") + """,
ends as (select subscription_url, min(arrived) as ended from label_frame where op = 'error' and name = 'FutureCursor' group by 1),
live as (select f.* from label_frame f left join ends using (subscription_url) where ended is null or arrived < ended),
each as (select subscription_url, seq, min(arrived) filter (valid) as good_at from live where op = 'labels' group by 1, 2),
stops as (select subscription_url, min(seq) as stop from each where good_at is null group by 1),
log as (select f.* from live f join each e on e.subscription_url = f.subscription_url and e.seq = f.seq and e.good_at = f.arrived left join stops s on s.subscription_url = f.subscription_url where s.stop is null or f.seq < s.stop)"""


def followed(spark, sf_dir) -> str:
    """The folder of the label log and the subscriptions' state after all frames."""
    folder = shared_dir(spark)
    for stream in as_streams(spark_view(spark, sf_dir, "label_frame"), folder, order="arrived"):
        S.follow(stream, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/state"


@query("stream_label_log", FOLLOWED + " select subscription_url, seq, label_index, id, src, uri, cid, val, neg, cts from log")
def stream_label_log(spark, sf_dir):
    return NTZ(S.label_log(spark, followed(spark, sf_dir)).select("subscription_url", "seq", "label_index", "id", "src", "uri", "cid", "val", "neg", "cts"), "cts")


@query("stream_label_cursors", FOLLOWED + """,
moved as (select subscription_url, max(seq) as last_seq, arg_max(ts, seq) as last_event_at from log group by 1),
handled as (select f.subscription_url, max(arrived) as handled_at from live f join each e using (subscription_url, seq) left join stops s using (subscription_url) where op = 'labels' and valid and (stop is null or seq < stop) group by 1),
calls as (select subscription_url, arg_max(ts, arrived) filter (op = 'connected') as last_connected_at, max(arrived) filter (op = 'connected') as connected_at,
    max(arrived) filter (op = 'error') as error_at, arg_max(message, arrived) filter (op = 'error') as said from live group by 1),
held as (select subscription_url, min(arrived) as held_at from live join stops using (subscription_url) where op = 'labels' and seq = stop group by 1),
fatal as (select subscription_url, arg_max(message, arrived) as message from label_frame where op = 'error' and name = 'FutureCursor' group by 1)
select u.subscription_url, last_seq, last_event_at, last_connected_at, stop as held_seq, 'FATAL_CURSOR FutureCursor: ' || message || '. Reset subscription cursor and replay labels.' as fatal,
    case when greatest(error_at, held_at) <= coalesce(greatest(connected_at, handled_at), -1) then null when held_at >= coalesce(error_at, -1) then 'persist labeler labels seq=' || stop when error_at is not null then 'labeler stream error: Busy: ' || said end as error
from (select distinct subscription_url from label_frame) u left join moved using (subscription_url) left join handled using (subscription_url) left join calls using (subscription_url) left join held using (subscription_url)
    left join stops using (subscription_url) left join fatal using (subscription_url)""")
def stream_label_cursors(spark, sf_dir):
    return NTZ(S.state_before(spark, followed(spark, sf_dir)), "last_event_at", "last_connected_at")


@query("stream_labels", FOLLOWED + f""",
top as (select * from log a where not exists (select 1 from log b where b.src = a.src and b.uri = a.uri and b.val = a.val and b.cid is not distinct from a.cid and (b.cts > a.cts or (b.cts = a.cts and b.id > a.id))))
select src, uri, cid, val, cts from top where not neg and (exp is null or exp > timestamp '{LABELS_AS_OF}')""")
def stream_labels(spark, sf_dir):
    return NTZ(L.active(S.label_log(spark, followed(spark, sf_dir)), as_of()).select("src", "uri", "cid", "val", "cts"), "cts")


@query("stream_labels_history", FOLLOWED + ", d as (select uri, cid from doc_record) select l.id, l.uri, l.val, l.neg from log l join d on l.uri = d.uri and (l.cid is null or l.cid = d.cid) where val <> 'spam'".replace("from doc_record", "from (" + sql_views("doc_record") + " select * from doc_record)"))
def stream_labels_history(spark, sf_dir):
    """activeOnly = false, from the stream's own log."""
    from ..operators import filters as W

    log = S.label_log(spark, followed(spark, sf_dir)).filter(W.label_condition({"val": {"neq": "spam"}}))
    subjects = spark_view(spark, sf_dir, "doc_record").select("uri", "cid").withColumn("place", F.lit(0))
    return L.for_subjects(subjects, log).select("id", "uri", "val", "neg")


# A label's next row decides how it ends, unless it expires before; without a next row it expires once the watermark has passed.
@query("stream_label_changes", FOLLOWED + """,
mark as (select max(cts) - interval 10 minute as at from log),
v as (select *, lead(cts) over w as next_cts, lead(neg) over w as next_neg from log window w as (partition by src, uri, val, cid order by cts, id)),
p as (select * from v where not neg and (exp is null or exp > cts))
select src, uri, val, cid, id, 'active' as change, cts as at from p
union all select src, uri, val, cid, id, case when next_neg then 'negated' else 'replaced' end, next_cts from p where next_cts is not null and (exp is null or exp > next_cts)
union all select src, uri, val, cid, id, 'expired', exp from p, mark where exp is not null and exp <= coalesce(next_cts, mark.at)""")
def stream_label_changes(spark, sf_dir):
    """Activations and ends of labels; expiries come from timers, a range of the log after another."""
    folder = shared_dir(spark)
    log = S.label_log(spark, followed(spark, sf_dir)).withColumn("order", F.unix_seconds("cts"))
    for stream in as_streams(log, folder, order="order"):
        K.kept(K.label_changes(stream), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return NTZ(spark.read.schema(K.LABEL_CHANGES).parquet(f"{folder}/changes"), "at")


def ingested(spark, sf_dir) -> str:
    """The folder of events and quarantine, from envelopes as files of JSON lines."""
    folder = shared_dir(spark)
    raw = spark_view(spark, sf_dir, "envelope")
    for part in range(3):
        raw.filter(F.col("seq") % 3 == part).select("value").write.mode("append").text(f"{folder}/raw")
        C.ingest_feed(E.json_lines(spark, f"{folder}/raw", stream=True), E.envelopes, f"{folder}/feed", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/feed"


@query("stream_envelopes", sql_views("record_event") + f" select seq, kind, did, {RECORD_FIELDS}, case when kind = 'identity' then handle end as handle, case when kind = 'identity' then status end as status from record_event where {READ}")
def stream_envelopes(spark, sf_dir):
    return spark.read.parquet(f"{ingested(spark, sf_dir)}/events").drop("live", "rev", "ts", "batch")


@query("stream_quarantine", sql_views("record_event") + " select case seq % 101 when 7 then 'missing did' else 'missing type' end as reason, count(*) as n from record_event where seq % 101 in (7, 8, 9) group by 1")
def stream_quarantine(spark, sf_dir):
    return spark.read.parquet(f"{ingested(spark, sf_dir)}/quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def counted(df, aggregate, folder: str, name: str):
    """The last state of a streaming aggregation in complete mode."""

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/{name}")

    for stream in as_streams(df, folder):
        aggregate(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/{name}")


@query("stream_counts", EVENTS + " select kind, coalesce(action, '') as action, count(*) as count from record_event group by all")
def stream_counts(spark, sf_dir):
    folder = shared_dir(spark)
    return counted(spark_view(spark, sf_dir, "record_event"), C.counters, folder, "counts")


@query("stream_buckets", """
select time_bucket(interval 30 minute, ts) as bucket, count(*) as total, count(*) filter (event_id % 3 = 0) as creates, count(*) filter (event_id % 3 = 1) as updates, count(*) filter (event_id % 3 = 2) as deletes from events group by 1""")
def stream_buckets(spark, sf_dir):
    folder = shared_dir(spark)
    activity = spark_view(spark, sf_dir, "activity").withColumn("seq", F.col("id"))
    return NTZ(counted(activity, lambda s: C.bucket_counts(s, 30, "60 days"), folder, "buckets"), "bucket")

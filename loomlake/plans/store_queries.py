"""Queries over stored forms: records by collection with parsed payloads, search index, dated log, roll-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.cursors import cursor
from ..functions.json_values import text_in
from ..operators import filters as W
from ..operators import pages as P
from ..operators import search_index as X
from ..shared import shared_dir
from ..sources import activity_log as A
from ..sources import record_store as R
from ..streaming import rollups as U
from .filter_queries import FIELDS, FILTERS, ORDERS
from .fixtures import AS_OF, spark_view, sql_views
from .label_queries import NTZ
from .record_queries import EVENTS, TIME_SERIES
from .registry import ORACLE_SQL, query
from .stream_queries import as_streams, changes

COLUMNS = ["uri", "cid", "did", "collection", "rkey", "json", "indexed_at", "record_created_at"]


def store(spark, sf_dir):
    """Orders and their customers' follow records, stored by collection."""
    path = f"{shared_dir(spark)}/records"
    orders = spark_view(spark, sf_dir, "order_doc").select(COLUMNS)
    R.write(orders.unionByName(spark_view(spark, sf_dir, "follow_record"), allowMissingColumns=True), path)
    return path


def orders(spark, sf_dir):
    return R.read(spark, store(spark, sf_dir), ["app.fixture.order"])


@query("stored_scan_newest", ORACLE_SQL["scan_newest"])
def stored_scan_newest(spark, sf_dir):
    return P.newest(R.read(spark, store(spark, sf_dir)), "app.fixture.order", 100).select("uri")


@query("stored_timeline", ORACLE_SQL["timeline"])
def stored_timeline(spark, sf_dir):
    rows = P.timeline(W.timeline_scope(R.read(spark, store(spark, sf_dir)), ["app.fixture.order", "app.fixture.other"]))
    return NTZ(rows.select("uri", "record_created_at"), "record_created_at")


def _stored_filter(name: str) -> None:
    @query(f"stored_{name}", ORACLE_SQL[name])
    def run(spark, sf_dir):
        return W.where(orders(spark, sf_dir), FILTERS[name][0], FIELDS, payload="payload").select("uri", "did", "cid")


for _name in ("filter_range", "filter_contains", "filter_presence", "filter_nested_path", "filter_array_any", "filter_conjunction", "filter_datetime"):
    _stored_filter(_name)


@query("stored_page_sorted_json", ORACLE_SQL["page_sorted_json"])
def stored_page_sorted_json(spark, sf_dir):
    rows = P.page(orders(spark, sf_dir), first=1000, field="note", direction="ASC", payload="payload").rows
    return rows.select("uri", text_in("payload", "note").alias("note"))


@query("stored_page_sorted_numeric", ORACLE_SQL["page_sorted_numeric"])
def stored_page_sorted_numeric(spark, sf_dir):
    after = spark.range(1).select(cursor(F.lit("700.0"), F.lit("")).alias("c")).first()["c"]
    rows = P.page(orders(spark, sf_dir), first=40, after=after, field="key", numeric=True, payload="payload").rows
    return rows.select("uri", text_in("payload", "key").cast("double").alias("key"))


@query("stored_changes", ORDERS + """ select uri, collection, case when cast(rkey as bigint) % 5 = 1 then 'changed' else cid end as cid from order_doc where cast(rkey as bigint) % 7 <> 2
    union all select uri || '/new', 'app.fixture.other', cid from order_doc where cast(rkey as bigint) % 100 = 0""")
def stored_changes(spark, sf_dir):
    """Orders after a batch of changes: some are changed, some deleted, a new collection comes up."""
    path = f"{shared_dir(spark)}/records"
    R.write(spark_view(spark, sf_dir, "order_doc").select(COLUMNS), path, per_bucket=2_000)
    # The batch follows from what is stored, so that orders aren't put together again for each part of it.
    whole, number = R.read(spark, path).select(COLUMNS), F.expr("cast(rkey as bigint)")
    changed = whole.filter((number % 5 == 1) & (number % 7 != 2)).withColumn("cid", F.lit("changed"))
    new = whole.filter(number % 100 == 0).withColumn("uri", F.concat("uri", F.lit("/new"))).withColumn("collection", F.lit("app.fixture.other"))
    R.apply(spark, path, changed.unionByName(new), whole.filter(number % 7 == 2).select("uri"))
    return R.read(spark, path).select("uri", "collection", "cid")


@query("search_indexed", ORACLE_SQL["search_text"])
def search_indexed(spark, sf_dir):
    docs = spark_view(spark, sf_dir, "doc_record").withColumn("json", F.to_json(F.struct("text")))
    path = f"{shared_dir(spark)}/index"
    X.write(docs.select("uri", "collection", "json"), path)
    return X.search(docs, path, "Licensed", "app.fixture.doc").select("uri")


@query("activity_log_retention", sql_views("activity") + f" select * from activity where timestamp >= timestamp '{AS_OF}' - interval 7 day")
def activity_log_retention(spark, sf_dir):
    path = f"{shared_dir(spark)}/log"
    activity = spark_view(spark, sf_dir, "activity")
    for batch in range(2):
        A.append(activity.filter(F.col("id") % 2 == batch), path, batch)
    return NTZ(A.retained(spark, path, datetime.fromisoformat(AS_OF)), "timestamp")


def rolled_up(spark, sf_dir) -> str:
    """Roll-ups kept from the log of changes, which come in three runs."""
    folder = shared_dir(spark)
    log = changes(spark, sf_dir)
    for stream in as_streams(log, folder):
        U.keep(stream, f"{folder}/rollup", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/rollup"


DAYS = TIME_SERIES[TIME_SERIES.index("cast(coalesce(") : TIME_SERIES.index(" as date, count(*)")]


@query("rollup_by_day", EVENTS + f" select collection, {DAYS} as date, count(*) as count from records group by all")
def rollup_by_day(spark, sf_dir):
    """Counts after updates, deletes and purges, from signed deltas only."""
    return U.by_day(spark, rolled_up(spark, sf_dir)).select("collection", "date", "count")


@query("rollup_authors", EVENTS + " select r.collection, count(*) as count, (select count(distinct did) from record_event e where e.collection = r.collection and kind = 'record' and action in ('create', 'update') and body is not null) as authors, true as within from records r group by r.collection")
def rollup_authors(spark, sf_dir):
    """Exact authors of each collection beside the sketches' estimate: within three standard errors."""
    found = U.by_collection(spark, rolled_up(spark, sf_dir))
    events = spark_view(spark, sf_dir, "record_event").filter("kind = 'record' and action in ('create', 'update') and body is not null")
    exact = events.groupBy("collection").agg(F.count_distinct("did").alias("exact"))
    near = F.abs(F.col("authors") - F.col("exact")) <= F.greatest(F.lit(1.0), 3 * U.ERROR * F.col("exact"))
    return found.join(exact, "collection").select("collection", "count", F.col("exact").alias("authors"), near.alias("within"))

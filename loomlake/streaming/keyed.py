"""Change events and labels through keyed state: a batch touches the keys of its rows only.

State lies in RocksDB, and what changes goes to append-only logs; tables are read from the logs by the newest row of a key. Rows that come again, or
later than what their record or author has seen already, change nothing. Inside the state, times are microseconds.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.times import normalised_created_at
from ..functions.uris import record_uri
from ..operators.records import is_purge
from ..operators.stats import record_day

# Executors then need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CHANGES = "seq long, action string, did string, collection string, rkey string, uri string, cid string, body string, ts timestamp, outcome string, record_created_at timestamp, old_day date, new_day date"
ACTOR_CHANGES = "did string, handle string, indexed_at timestamp, gone boolean, version long"
TIMES, DAYS = {"ts", "record_created_at", "indexed_at", "at"}, {"old_day", "new_day"}
LABEL_CHANGES = "src string, uri string, val string, cid string, id long, change string, at timestamp"


def inner(schema: str) -> str:
    """A schema with its times as microseconds, as the state gives them out."""
    return ", ".join(f"{c} long" if c in TIMES else f"{c} int" if c in DAYS else f"{c} {kind}" for c, kind in (f.split() for f in schema.split(", ")))


def timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) if c in TIMES else F.date_from_unix_date(c) for c in rows.columns if c in TIMES | DAYS})


@contextmanager
def rocksdb(spark: SparkSession):
    """State of queries that are started inside lies in RocksDB; the session's own setting comes back."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def kept(rows: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream's rows to Parquet files, each exactly once."""
    with rocksdb(rows.sparkSession):
        return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


#: Pages that parts of authors are dealt over.
PAGES = 2048


class RecordState(StatefulProcessor):
    """Records of a page of authors' parts: the last event of each URI with what is stored, deleted ones as a mark, and each author's last purge.

    A page is one value, as JSON, and is read and written once a batch: each call to the state goes through a socket, so a call for each record or
    part would cost more than the work.
    """

    def init(self, handle) -> None:
        self.page = handle.getValueState("page", "authors string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.page.get()
        # Author: [last purge, {uri: [seq, alive, cid, created, collection, rkey, day]}]
        authors = json.loads(kept[0]) if kept else {}
        out, changed = Row(*(f.split()[0] for f in CHANGES.split(", "))), False
        for _, seq, action, did, collection, rkey, uri, cid, body, ts, created, day in sorted(rows, key=lambda r: r[1]):
            author = authors.get(did)
            if author is None:
                author = [-1, {}]
            purged, records = author
            if uri is None:
                if seq <= purged:
                    continue
                author[0], changed = seq, True
                authors[did] = author
                for gone, old in [*records.items()]:
                    if old[0] < seq:
                        del records[gone]
                        if old[1]:
                            yield out(seq, "purge", did, old[4], old[5], gone, None, None, ts, "purged", None, old[6], None)
                continue
            old = records.get(uri)
            if seq <= max(purged, old[0] if old else -1):
                yield out(seq, action, did, collection, rkey, uri, cid, body, ts, "late", None, None, None)
                continue
            if action != "delete" and (action not in ("create", "update") or body is None):
                yield out(seq, action, did, collection, rkey, uri, cid, body, ts, "ignored", None, None, None)
                continue
            authors[did], changed = author, True
            alive = old is not None and old[1]
            if action == "delete":
                records[uri] = [seq, False, None, None, collection, rkey, None]
                yield out(seq, action, did, collection, rkey, uri, cid, body, ts, "deleted", None, old[6] if old else None, None)
                continue
            created = old[3] if alive and old[3] is not None else created
            same = alive and bool(cid) and old[2] == cid
            records[uri] = [seq, True, cid or "", created, collection, rkey, old[6] if same else day]
            if same:
                yield out(seq, action, did, collection, rkey, uri, cid, body, ts, "skipped", created, None, None)
            else:
                yield out(seq, action, did, collection, rkey, uri, cid, body, ts, "updated" if alive else "created", created, old[6] if alive else None, day)
        if changed:
            self.page.update((json.dumps(authors),))

    def close(self) -> None:
        pass


def record_changes(events: DataFrame, parts: int = 16, pages: int = PAGES) -> DataFrame:
    """CHANGES of a stream of change events, one row for each record event and for each record that a purge removes.

    old_day and new_day: the days that the record left and came to (`stats.record_day`), where that changed anything. An author's records are dealt over `parts` parts by URI, and a purge goes to all of them, so an author with a third of all records
    isn't one key. Parts of all authors share `pages` keys, and a batch reads and writes the pages of its rows only; a page holds as many records as all authors have, divided by `pages`, so take more pages for very large tables (a checkpoint keeps its number).
    A page's events of one batch are sorted in memory; how many there are is bounded by the source's limit for a batch (maxFilesPerTrigger). outcome: created, updated, skipped (equal content), deleted, ignored (no body), purged, late.
    """
    uri = F.when(F.col("kind") == "record", record_uri("did", "collection", "rkey"))
    page_of = lambda part: F.pmod(F.xxhash64("did", part), F.lit(pages)).cast("int")
    own = F.array(page_of(F.pmod(F.xxhash64(uri), F.lit(parts)).cast("int")))
    every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), page_of))
    rows = events.filter((F.col("kind") == "record") | is_purge()).select(
        F.explode(F.when(F.col("kind") == "record", own).otherwise(every)).alias("page"),
        "seq", "action", "did", "collection", "rkey", uri.alias("uri"), "cid", "body", F.unix_micros("ts").alias("ts"), F.unix_micros(normalised_created_at("body")).alias("created"), F.unix_date(record_day("body", "ts")).alias("day"),
    )
    return timed(rows.groupBy("page").transformWithState(RecordState(), inner(CHANGES), "Append", "None"))


def records_of(changes: DataFrame) -> DataFrame:
    """The table of records from the log of their changes."""
    content = F.when(F.col("outcome").isin("created", "updated"), F.col("seq"))
    known = F.when(F.col("outcome").isin("created", "updated", "skipped"), F.col("seq"))
    last = (
        changes.filter(F.col("outcome").isin("created", "updated", "skipped", "deleted", "purged"))
        .groupBy("uri")
        .agg(
            F.max_by("outcome", "seq").alias("outcome"),
            F.max_by(F.coalesce("cid", F.lit("")), content).alias("cid"),
            F.max_by("did", "seq").alias("did"),
            F.max_by("collection", "seq").alias("collection"),
            F.max_by("rkey", "seq").alias("rkey"),
            F.max_by("body", content).alias("json"),
            F.max_by("ts", content).alias("indexed_at"),
            F.max_by("record_created_at", known).alias("record_created_at"),
        )
    )
    return last.filter(~F.col("outcome").isin("deleted", "purged")).drop("outcome")


class ActorState(StatefulProcessor):
    """An author's handle: that of the last event, the last that isn't empty, or (`only_missing`) of the first since the last purge."""

    def __init__(self, blank_handle: bool, only_missing: bool):
        self.blank_handle, self.only_missing = blank_handle, only_missing

    def init(self, handle) -> None:
        self.state = handle.getValueState("actor", "version long, purged long, handle string, handle_seq long, ts long, ts_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, purged, handle, handle_seq, ts, ts_seq = self.state.get() if self.state.exists() else (0, -1, None, None, None, None)
        before = (purged, handle, ts)
        for e in sorted(rows, key=lambda r: r.seq):
            if e.purge:
                if e.seq > purged:
                    purged = e.seq
                    if ts_seq is not None and ts_seq < purged:
                        ts = ts_seq = None
                    if handle_seq is not None and handle_seq < purged:
                        handle = handle_seq = None
            elif e.seq > purged:
                if ts_seq is None or (e.seq < ts_seq if self.only_missing else e.seq > ts_seq):
                    ts, ts_seq = e.ts, e.seq
                if (self.blank_handle or self.only_missing or e.handle) and (handle_seq is None or (e.seq < handle_seq if self.only_missing else e.seq > handle_seq)):
                    handle, handle_seq = e.handle, e.seq
        if (purged, handle, ts) != before:
            version += 1
            self.state.update((version, purged, handle, handle_seq, ts, ts_seq))
            yield Row(did=key[0], handle=handle or "", indexed_at=ts, gone=ts_seq is None, version=version)

    def close(self) -> None:
        pass


def actor_changes(events: DataFrame, blank_handle: bool = True, only_missing: bool = False) -> DataFrame:
    """ACTOR_CHANGES of a stream of change events; the rules are those of `records.current_actors`."""
    seen = ((F.col("kind") == "record") & F.col("action").isin("create", "update") & F.col("body").isNotNull()) | (F.col("kind") == "identity")
    rows = events.filter(seen).select("did", "seq", F.unix_micros("ts").alias("ts"), F.coalesce("handle", F.lit("")).alias("handle"), is_purge().alias("purge"))
    return timed(rows.groupBy("did").transformWithState(ActorState(blank_handle, only_missing), inner(ACTOR_CHANGES), "Append", "None"))


def actors_of(changes: DataFrame) -> DataFrame:
    last = changes.groupBy("did").agg(F.max_by(F.struct("handle", "indexed_at", "gone"), "version").alias("a"))
    return last.filter("not a.gone").select("did", "a.handle", "a.indexed_at")


class LabelState(StatefulProcessor):
    """The newest label of a key; a timer at its expiry says when it ends."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "cts long, id long, neg boolean, exp long, active boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = tuple(self.state.get()) if self.state.exists() else None
        first = newest
        for r in sorted(rows, key=lambda r: (r.cts, r.id)):
            if newest and (r.cts, r.id) <= newest[:2]:
                continue
            # A label that ended before this one came ends by itself, at its timer or here.
            if newest and newest[4]:
                if newest[3] is not None and newest[3] <= r.cts:
                    yield self.row(key, newest[1], "expired", newest[3])
                else:
                    yield self.row(key, newest[1], "negated" if r.neg else "replaced", r.cts)
            active = not r.neg and (r.exp is None or r.exp > r.cts)
            newest = (r.cts, r.id, r.neg, r.exp, active)
            if active:
                yield self.row(key, r.id, "active", r.cts)
        if newest != first:
            if first and first[4] and first[3] is not None:
                self.handle.deleteTimer(millis(first[3]))
            if newest[4] and newest[3] is not None:
                self.handle.registerTimer(millis(newest[3]))
            self.state.update(newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        newest = tuple(self.state.get()) if self.state.exists() else None
        if newest and newest[4] and newest[3] is not None and millis(newest[3]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((*newest[:4], False))
            yield self.row(key, newest[1], "expired", newest[3])

    @staticmethod
    def row(key, number, change, at):
        return Row(src=key[0], uri=key[1], val=key[2], cid=key[3], id=number, change=change, at=at)

    def close(self) -> None:
        pass


def millis(micros: int) -> int:
    """Rounded up, so that a timer never comes early."""
    return -(-micros // 1000)


def label_changes(labels: DataFrame, late: str = "10 minutes") -> DataFrame:
    """LABEL_CHANGES of a stream of stored labels: when each becomes active, and when it is negated, replaced or expires.

    Event time is `received_at`. A label's end is emitted when the watermark passes its expiry, without any further row of its key; a label
    that is older than the newest of its key changes nothing.
    """
    rows = labels.withWatermark("received_at", late).select("src", "uri", "val", "cid", "id", "neg", F.unix_micros("cts").alias("cts"), F.unix_micros("exp").alias("exp"), "received_at")
    return timed(rows.groupBy("src", "uri", "val", "cid").transformWithState(LabelState(), inner(LABEL_CHANGES), "Append", "EventTime"))

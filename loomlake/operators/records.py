"""Current state of records and actors, folded from ordered change events.

An upsert whose content id is not empty and equals the stored one changes nothing but a missing
created-at; any other replaces content and indexed-at. The first known created-at stays until the
record is deleted. A purge of an author removes all that came before it. Every shuffle is by
URI (or by author for actors); nothing is grouped by collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import normalised_created_at
from ..functions.uris import record_uri
from ..schemas import PURGING_STATUSES

RECORD_COLUMNS = ["uri", "cid", "did", "collection", "rkey", "json", "indexed_at", "record_created_at"]


def is_purge():
    """Identity events whose status removes the author; `is_active` never decides."""
    return (F.col("kind") == "identity") & F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(*PURGING_STATUSES)


def last_purges(events: DataFrame) -> DataFrame:
    return events.filter(is_purge()).groupBy("did").agg(F.max("seq").alias("purged_at"))


def after_purges(events: DataFrame) -> DataFrame:
    """Events that no later purge of their author undoes."""
    kept = events.join(last_purges(events), "did", "left")
    return kept.filter(F.col("purged_at").isNull() | (F.col("seq") > F.col("purged_at"))).drop("purged_at")


def upserts_and_deletes(events: DataFrame) -> DataFrame:
    """uri, seq, is_delete, cid, did, collection, rkey, json, ts, created of record events that count."""
    upsert = F.col("action").isin("create", "update") & F.col("body").isNotNull()
    return events.filter((F.col("kind") == "record") & (upsert | (F.col("action") == "delete"))).select(
        record_uri("did", "collection", "rkey").alias("uri"),
        "seq",
        (F.col("action") == "delete").alias("is_delete"),
        F.coalesce("cid", F.lit("")).alias("cid"),
        "did",
        "collection",
        "rkey",
        F.col("body").alias("json"),
        "ts",
        normalised_created_at("body").alias("created"),
    )


def marked(events: DataFrame) -> DataFrame:
    """Upserts since the last delete of their URI, with `effective`: whether they replaced content."""
    by_uri = Window.partitionBy("uri")
    alive = (
        events.withColumn("deleted_at", F.max(F.when(F.col("is_delete"), F.col("seq"))).over(by_uri))
        .filter(~F.col("is_delete") & (F.col("deleted_at").isNull() | (F.col("seq") > F.col("deleted_at"))))
        .drop("deleted_at", "is_delete")
    )
    before = F.lag("cid").over(by_uri.orderBy("seq"))
    return alive.withColumn("effective", ~((F.col("cid") != "") & F.coalesce(before == F.col("cid"), F.lit(False))))


def folded(events: DataFrame) -> DataFrame:
    replaced = F.when(F.col("effective"), F.col("seq"))
    known = F.when(F.col("created").isNotNull(), F.col("seq"))
    return (
        marked(events)
        .groupBy("uri")
        .agg(
            F.max_by("cid", "seq").alias("cid"),
            F.min_by("did", "seq").alias("did"),
            F.min_by("collection", "seq").alias("collection"),
            F.min_by("rkey", "seq").alias("rkey"),
            F.max_by("json", replaced).alias("json"),
            F.max_by("ts", replaced).alias("indexed_at"),
            F.min_by("created", known).alias("record_created_at"),
        )
        .select(*RECORD_COLUMNS)
    )


def current_records(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Records after `events`, on top of `snapshot` (the records before them) if given.

    Snapshot rows take part as upserts that come before all events.
    """
    changes = upserts_and_deletes(after_purges(events))
    if snapshot is None:
        return folded(changes)
    kept = snapshot.join(last_purges(events).select("did"), "did", "left_anti")
    old = kept.select(
        "uri", F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("is_delete"), "cid", "did", "collection", "rkey", "json",
        F.col("indexed_at").alias("ts"), F.col("record_created_at").alias("created"),
    )
    return folded(old.unionByName(changes))


def current_actors(events: DataFrame, snapshot: DataFrame | None = None, blank_handle: bool = True, only_missing: bool = False) -> DataFrame:
    """did, handle, indexed_at after `events`.

    blank_handle: a record event overwrites the handle with '' (the envelope feed's rule), else
    the last non-empty handle stays. only_missing: the first event of an author decides (the commit feed).
    """
    kept = after_purges(events)
    seen = ((F.col("kind") == "record") & F.col("action").isin("create", "update") & F.col("body").isNotNull()) | ((F.col("kind") == "identity") & ~is_purge())
    rows = kept.filter(seen).select("did", "seq", F.coalesce("handle", F.lit("")).alias("handle"), "ts")
    if snapshot is not None:
        old = snapshot.join(last_purges(events).select("did"), "did", "left_anti")
        rows = rows.unionByName(old.select("did", F.lit(-1).cast("long").alias("seq"), "handle", F.col("indexed_at").alias("ts")))
    if only_missing:
        return rows.groupBy("did").agg(F.min_by("handle", "seq").alias("handle"), F.min_by("ts", "seq").alias("indexed_at"))
    at = F.col("seq") if blank_handle else F.when(F.col("handle") != "", F.col("seq"))
    return rows.groupBy("did").agg(F.coalesce(F.max_by("handle", at), F.lit("")).alias("handle"), F.max_by("ts", "seq").alias("indexed_at"))


def merge_batch(snapshot: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Batch upsert: every incoming row replaces its record and is stamped anew; the last of equal URIs wins."""
    last = incoming.groupBy("uri").agg(*[F.max_by(c, order).alias(c) for c in RECORD_COLUMNS[1:]])
    old = snapshot.select("uri", *[F.col(c).alias(f"old_{c}") for c in RECORD_COLUMNS[1:]])
    both = old.join(last, "uri", "full")
    new = F.col("json").isNotNull()
    pick = {c: F.when(new, F.col(c)).otherwise(F.col(f"old_{c}")) for c in ("cid", "json", "indexed_at")}
    pick |= {c: F.coalesce(F.col(f"old_{c}"), F.col(c)) for c in ("did", "collection", "rkey", "record_created_at")}
    return both.select("uri", *[pick[c].alias(c) for c in RECORD_COLUMNS[1:]])


def merge_actors(snapshot: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Batch upsert of actors: the last incoming handle of each author replaces the stored one."""
    last = incoming.groupBy("did").agg(F.max_by("handle", order).alias("handle"), F.max_by("indexed_at", order).alias("indexed_at"))
    return snapshot.join(last, "did", "left_anti").unionByName(last)


def delete_uris(records: DataFrame, uris: DataFrame) -> DataFrame:
    return records.join(uris.select("uri"), "uri", "left_anti")


def purge_authors(records: DataFrame, actors: DataFrame, dids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the authors, to be published as one version."""
    return records.join(dids.select("did"), "did", "left_anti"), actors.join(dids.select("did"), "did", "left_anti")


RESET_TABLES = ("activity", "reports", "labels", "records", "actors")


def reset(tables: dict[str, DataFrame], confirm: str) -> dict[str, DataFrame]:
    """Empties activity, reports, labels, records and actors; other tables stay."""
    if confirm != "RESET":
        raise ValueError("confirm with 'RESET'")
    return {name: df.limit(0) if name in RESET_TABLES else df for name, df in tables.items()}


def new_content(incoming: DataFrame, existing: DataFrame, dedup: str = "cid") -> DataFrame:
    """Rows of a backfill to import: those whose content id (or URI and content id) is not stored."""
    on = {"cid": ["cid"], "uri_cid": ["uri", "cid"]}[dedup]
    return incoming.join(existing.select(*on).distinct(), on, "left_anti")


def import_counts(incoming: DataFrame, existing: DataFrame, dedup: str = "cid") -> DataFrame:
    """One row: authors, processed, inserted and skipped rows of a backfill."""
    on = {"cid": ["cid"], "uri_cid": ["uri", "cid"]}[dedup]
    known = existing.select(*on).distinct().withColumn("stored", F.lit(True))
    found = incoming.join(known, on, "left")
    return found.agg(
        F.count_distinct("did").alias("authors"), F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("stored").isNull()).alias("inserted"), F.count_if(F.col("stored").isNotNull()).alias("skipped"),
    )


def import_report(incoming: DataFrame, existing: DataFrame, found: DataFrame, started: Column, ended: Column, dedup: str = "cid") -> DataFrame:
    """`import_counts` of the readable rows with repositories found (rows of `found`), errors (rows whose JSON can't be read) and seconds taken."""
    read = incoming.withColumn("good", F.try_parse_json("json").isNotNull())
    errors = read.agg(F.count_if(~F.col("good")).alias("errors"))
    repos = found.agg(F.count_distinct("did").alias("repos"))
    counts = import_counts(read.filter("good"), existing, dedup)
    seconds = (ended.cast("double") - started.cast("double")).alias("seconds")
    return counts.crossJoin(F.broadcast(errors)).crossJoin(F.broadcast(repos)).select("repos", *counts.columns, "errors", seconds)  # one row each


def import_records(records: DataFrame, incoming: DataFrame, did: str | None = None, fast: bool = True) -> DataFrame:
    """Records after a backfill of exported rows, or of one author's (did).

    fast: rows whose content id is stored are left out and the rest replaces its records (`merge_batch`). Otherwise the
    fallback: rows stored with the same URI and content id are left out and the rest is applied as events are.
    incoming: the columns of records and seq.
    """
    rows = incoming.filter(F.col("did") == did) if did else incoming
    fresh = new_content(rows, records, "cid" if fast else "uri_cid")
    if fast:
        return merge_batch(records, fresh)
    events = fresh.select("seq", F.lit("record").alias("kind"), F.lit("create").alias("action"), "did", "collection", "rkey", "cid", F.col("json").alias("body"), F.lit("").alias("status"), F.col("indexed_at").alias("ts"))
    return current_records(events, records)


def in_uri_order(records: DataFrame) -> DataFrame:
    """All records by URI, range-partitioned, so partitions in a row are the whole order."""
    return records.orderBy("uri")


def stored_cids(records: DataFrame, uris: DataFrame) -> DataFrame:
    """uri, cid of the records among `uris`."""
    return records.select("uri", "cid").join(uris.select("uri").distinct(), "uri", "left_semi")


def existing_cids(records: DataFrame, cids: DataFrame) -> DataFrame:
    return cids.select("cid").distinct().join(records.select("cid"), "cid", "left_semi")


def repos_of(*collections: DataFrame) -> DataFrame:
    """Distinct authors over the listings of several collections."""
    every = collections[0].select("did")
    for more in collections[1:]:
        every = every.unionByName(more.select("did"))
    return every.distinct()

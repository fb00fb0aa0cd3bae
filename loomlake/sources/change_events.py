"""Change feeds to one table of ordered events (schemas.CHANGE_EVENT).

Both feeds arrive as JSON text, a row each, in a batch or a stream: `value` holds the envelope.
Bodies stay raw text. Rows that break the envelope's rules go to quarantine, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_values import parsed_once
from ..functions.uris import in_namespace
from ..schemas import CHANGE_EVENT

ENVELOPE = "id long, type string, record struct<live: boolean, rev: string, did: string, collection: string, rkey: string, action: string, cid: string>, identity struct<did: string, handle: string, is_active: boolean, status: string>"
COMMIT = "did string, time_us long, kind string, commit struct<rev: string, operation: string, collection: string, rkey: string, cid: string>"
COLUMNS = [c.split()[0] for c in CHANGE_EVENT.split(", ")]


def json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files of one JSON document a line, as `value`, with the time their file arrived as `arrived`."""
    return (spark.readStream if stream else spark.read).text(path).select("value", F.col("_metadata.file_modification_time").alias("arrived"))


def missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def envelopes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of the envelope feed: record events and identity events.

    An event's time is its row's `arrived`, so a batch that is read again gives the same rows; without that column it is the time of reading. A create or update without a body is valid; applying it changes nothing.
    """
    arrived = F.col("arrived") if "arrived" in raw.columns else F.current_timestamp()
    e = raw.select("value", arrived.alias("arrived"), parsed_once("value", ENVELOPE).alias("e"), F.get_json_object("value", "$.record.record").alias("body"))
    r, i = F.col("e.record"), F.col("e.identity")
    reason = (
        F.when(F.col("e").isNull() | missing(F.col("e.type")), "missing type")
        .when(~F.col("e.type").isin("record", "identity"), "unknown type")
        .when((F.col("e.type") == "record") & r.isNull(), "missing record")
        .when((F.col("e.type") == "identity") & i.isNull(), "missing identity")
        .when((F.col("e.type") == "identity") & missing(i["did"]), "missing did")
        .when((F.col("e.type") == "record") & missing(r["did"]), "missing did")
        .when((F.col("e.type") == "record") & missing(r["collection"]), "missing collection")
        .when((F.col("e.type") == "record") & missing(r["rkey"]), "missing rkey")
        .when((F.col("e.type") == "record") & missing(r["action"]), "missing action")
    )
    checked = e.withColumn("reason", reason)
    good = checked.filter("reason is null").select(
        F.col("e.id").alias("seq"),
        F.col("e.type").alias("kind"),
        r["action"].alias("action"),
        F.coalesce(r["did"], i["did"]).alias("did"),
        r["collection"].alias("collection"),
        r["rkey"].alias("rkey"),
        r["cid"].alias("cid"),
        "body",
        i["handle"].alias("handle"),
        i["status"].alias("status"),
        r["live"].alias("live"),
        r["rev"].alias("rev"),
        F.col("arrived").alias("ts"),
    )
    return good, checked.filter("reason is not null").select("value", "reason")


def commits(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of the commit feed; only commits count, other kinds are left out."""
    e = raw.select("value", parsed_once("value", COMMIT).alias("e"), F.get_json_object("value", "$.commit.record").alias("body"))
    c = F.col("e.commit")
    reason = F.when(F.col("e").isNull() | missing(F.col("e.kind")), "missing kind").when((F.col("e.kind") == "commit") & (c.isNull() | missing(F.col("e.did"))), "missing commit")
    checked = e.withColumn("reason", reason)
    good = checked.filter("reason is null and e.kind = 'commit'").select(
        F.col("e.time_us").alias("seq"),
        F.lit("record").alias("kind"),
        c["operation"].alias("action"),
        F.col("e.did").alias("did"),
        c["collection"].alias("collection"),
        c["rkey"].alias("rkey"),
        c["cid"].alias("cid"),
        "body",
        F.lit(None).cast("string").alias("handle"),
        F.lit(None).cast("string").alias("status"),
        F.lit(True).alias("live"),
        c["rev"].alias("rev"),
        F.timestamp_micros(F.col("e.time_us")).alias("ts"),
    )
    return good, checked.filter("reason is not null").select("value", "reason")


def wanted(events: DataFrame, collections: list[str]) -> DataFrame:
    """Record events of the wanted collections, and all identity events."""
    return events.filter((F.col("kind") == "identity") | in_namespace("collection", collections))


def exported(spark: SparkSession, path: str, collections: list[str] | None = None, did: str | None = None) -> DataFrame:
    """Records of exported repositories (uri, cid, did, collection, rkey, json) for a backfill."""
    found = spark.read.parquet(path)
    if collections:
        found = found.filter(in_namespace("collection", collections))
    return found.filter(F.col("did") == did) if did else found

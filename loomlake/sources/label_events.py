"""Label feed: an event is a list of labels; each becomes a row with its place in the event.

One bad label (no src, uri or val, or a time that isn't RFC 3339) makes all labels of its event invalid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json_values import parsed_once
from ..functions.times import strict

LABEL = "struct<ver: int, src: string, uri: string, cid: string, val: string, neg: boolean, cts: string, exp: string, sig: binary>"


def label_rows(raw: DataFrame) -> DataFrame:
    """From (subscription_url, value, received_at): one row for each label of each event, bad ones marked.

    `seq` and `labels` come from the event; an event without labels has one row with a null
    label_index, so the cursor can still move.
    """
    e = raw.select("subscription_url", "received_at", parsed_once("value", f"seq long, labels array<{LABEL}>").alias("e"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    good = lambda x: ~(blank(x["src"]) | blank(x["uri"]) | blank(x["val"]) | strict(x["cts"]).isNull() | (~blank(x["exp"]) & strict(x["exp"]).isNull()))
    e = e.withColumn("valid", F.coalesce(F.forall("e.labels", good), F.lit(True)))
    rows = e.select("subscription_url", "received_at", "valid", F.col("e.seq").alias("seq"), F.posexplode_outer("e.labels").alias("label_index", "l"))
    return rows.select(
        "subscription_url",
        "seq",
        "label_index",
        "l.src",
        "l.uri",
        "l.cid",
        "l.val",
        F.coalesce("l.neg", F.lit(False)).alias("neg"),
        strict(F.col("l.cts")).alias("cts"),
        strict(F.col("l.exp")).alias("exp"),
        F.base64("l.sig").alias("sig"),
        "l.ver",
        F.to_json("l").alias("raw_json"),
        "received_at",
        "valid",
    )

"""Moderation labels, definitions, viewer preferences and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import strict
from ..schemas import REPORT_REASONS, SEVERITIES, VISIBILITIES


def active(labels: DataFrame) -> DataFrame:
    """Labels that no later negation (by id) of the same uri and val undoes, from any source; expiry isn't checked."""
    last = F.max(F.when(F.col("neg"), F.col("id"))).over(Window.partitionBy("uri", "val"))
    return labels.withColumn("__negated", last).filter(~F.col("neg") & (F.col("__negated").isNull() | (F.col("id") > F.col("__negated")))).drop("__negated")


def takedowns(labels: DataFrame) -> DataFrame:
    """Distinct URIs that are taken down."""
    return active(labels.filter(F.col("val") == "!takedown")).select("uri").distinct()


def definitions(table: DataFrame, system: bool = True) -> DataFrame:
    """Label definitions by value; without `system`, those whose value doesn't start with !."""
    return (table if system else table.filter(~F.col("val").startswith("!"))).orderBy("val")


def accepted_labels(new: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels to append, rejected): the subject is a URI or DID, the value defined, the expiry a time in RFC 3339."""
    ok = (F.col("uri").startswith("at://") | F.col("uri").startswith("did:")) & (F.col("exp_text").isNull() | strict(F.col("exp_text")).isNotNull())
    marked = new.join(known.select("val", F.lit(True).alias("__defined")), "val", "left").withColumn("__ok", F.coalesce(ok & F.col("__defined"), F.lit(False)))
    good = marked.filter("__ok").withColumn("exp", strict(F.col("exp_text"))).drop("__ok", "__defined", "exp_text")
    return good, marked.filter("not __ok").drop("__ok", "__defined")


def accepted_definitions(new: DataFrame, known: DataFrame, order: str = "id") -> DataFrame:
    """New definitions with a value not known yet and valid settings; of equal values the first by `order` wins (without that column, the smallest row)."""
    fixed = new.withColumn("default_visibility", F.coalesce("default_visibility", F.lit("warn")))
    good = fixed.filter(F.col("severity").isin(*SEVERITIES) & F.col("default_visibility").isin(*VISIBILITIES))
    first = good.groupBy("val").agg(F.min(F.struct(*sorted((c for c in good.columns if c != "val"), key=lambda c: c != order))).alias("__first")).select("val", "__first.*").select(good.columns)
    return first.join(known.select("val"), "val", "left_anti")


def preferences(changes: DataFrame) -> DataFrame:
    """The last visibility of each (did, label_val); a null visibility deletes the preference."""
    last = changes.groupBy("did", "label_val").agg(F.max_by("visibility", "ts").alias("visibility"), F.max("ts").alias("ts"))
    return last.filter("visibility is not null")


def visibility(table: DataFrame, prefs: DataFrame, did: str) -> DataFrame:
    """For a viewer: every definition that isn't a system one, with their own setting or the default."""
    own = prefs.filter(F.col("did") == did).select(F.col("label_val").alias("val"), "visibility")
    return definitions(table, system=False).join(own, "val", "left").select(
        "val", "severity", "default_visibility", F.coalesce("visibility", "default_visibility").alias("visibility")
    )


def accepted_reports(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New reports: a valid reason, the first of each reporter and subject."""
    first = Window.partitionBy("reporter_did", "subject_uri").orderBy("id")
    good = new.filter(F.col("reason_type").isin(*REPORT_REASONS)).withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank")
    return good if known is None else good.join(known.select("reporter_did", "subject_uri"), ["reporter_did", "subject_uri"], "left_anti")


def resolved(reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports with their status, labels to insert). decisions: id, action (apply_label, dismiss), val, src, ts; the last one counts."""
    last = decisions.groupBy("id").agg(F.max_by(F.struct("action", "val", "src", "ts"), "ts").alias("d"))
    joined = reports.join(last, "id", "left")
    status = F.when(F.col("d.action") == "apply_label", "resolved").when(F.col("d.action") == "dismiss", "dismissed").otherwise(F.col("status"))
    made = joined.filter("d.action = 'apply_label'").select(F.col("d.src").alias("src"), F.col("subject_uri").alias("uri"), F.col("d.val").alias("val"), F.lit(False).alias("neg"), F.col("d.ts").alias("cts"))
    return joined.withColumn("status", status).drop("d"), made

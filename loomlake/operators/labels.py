"""External labels: ingest, active state, filters by label, hydration, subscription state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["subscription_url", "seq", "label_index"]


def ingest(rows: DataFrame, order: str = "received_at") -> tuple[DataFrame, DataFrame]:
    """(labels, rejected): an event with any bad label is rejected whole; of rows with one key the first by `order` stays, so replays change nothing."""
    ok = F.min("valid").over(Window.partitionBy("subscription_url", "seq"))
    checked = rows.withColumn("event_valid", ok)
    good = checked.filter("event_valid and label_index is not null")
    rest = [c for c in good.columns if c not in (*KEY, order, "raw_json")] + ["raw_json"] * ("raw_json" in good.columns)
    good = good.groupBy(*KEY).agg(F.min(F.struct(order, *rest)).alias("__first")).select(*KEY, "__first.*").select(good.columns)
    return good.drop("valid", "event_valid"), checked.filter("not event_valid").drop("event_valid")


def cursors(rows: DataFrame, fatal: DataFrame | None = None) -> DataFrame:
    """The last sequence number of each subscription; events without labels count.

    A rejected event stores nothing and holds the cursor before it; a subscription that is marked fatal doesn't move.
    """
    seen = rows.groupBy("subscription_url", "seq").agg(F.min("valid").alias("valid"), F.max("received_at").alias("at"))
    held = seen.groupBy("subscription_url").agg(F.min(F.when(~F.col("valid"), F.col("seq"))).alias("held"))
    free = seen.join(held, "subscription_url").filter("valid and (held is null or seq < held)")
    last = free.groupBy("subscription_url").agg(F.max("seq").alias("last_seq"), F.max_by("at", "seq").alias("last_event_at"))
    return last if fatal is None else last.join(fatal.select("subscription_url"), "subscription_url", "left_anti")


def newest(labels: DataFrame) -> DataFrame:
    """The newest label of each (src, uri, val, cid); a missing cid is a value of its own."""
    w = Window.partitionBy("src", "uri", "val", "cid").orderBy(F.col("cts").desc(), F.col("id").desc())
    return labels.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def active(labels: DataFrame, as_of: Column) -> DataFrame:
    """Newest labels that are neither negated nor expired; an older label never comes back."""
    return newest(labels).filter(~F.col("neg") & (F.col("exp").isNull() | (F.col("exp") > as_of)))


def chosen(labels: DataFrame, sources: list[str] | None = None, values: list[str] | None = None, active_only: bool = True, as_of: Column | None = None) -> DataFrame:
    found = active(labels, as_of) if active_only else labels
    if sources:
        found = found.filter(F.col("src").isin(sources))
    return found.filter(F.col("val").isin(values)) if values else found


def by_record_label(records: DataFrame, labels: DataFrame, has: bool = True) -> DataFrame:
    """Records that have (or lack) a label on their URI, for any or their own content id."""
    subjects = labels.select(F.col("uri").alias("l_uri"), F.col("cid").alias("l_cid"))
    same = (records["uri"] == subjects["l_uri"]) & (F.col("l_cid").isNull() | (F.col("l_cid") == records["cid"]))
    return records.join(subjects, same, "left_semi" if has else "left_anti")


def by_author_label(records: DataFrame, labels: DataFrame, has: bool = True) -> DataFrame:
    """Records whose author has (or lacks) a label without content id."""
    subjects = labels.filter("cid is null").select(F.col("uri").alias("did")).distinct()
    return records.join(subjects, "did", "left_semi" if has else "left_anti")


def for_subjects(subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of subjects (place, uri, cid), in their order, newest first; repeated subjects count once."""
    first = subjects.groupBy(F.col("uri").alias("s_uri"), F.col("cid").alias("s_cid")).agg(F.min("place").alias("place"))
    same = (labels["uri"] == first["s_uri"]) & (F.col("s_cid").isNull() | labels["cid"].isNull() | (labels["cid"] == F.col("s_cid")))
    return labels.join(first, same).drop("s_uri", "s_cid").orderBy("place", F.col("cts").desc(), F.col("id").desc())


def hydrated(records: DataFrame, labels: DataFrame, column: str = "externalLabels", key: str = "uri") -> DataFrame:
    """`records` with an array of their labels, newest first; key 'did' attaches the author's."""
    subjects = records.select(F.col(key).alias("s"), *([F.col("cid").alias("s_cid")] if key == "uri" else [])).distinct()
    given = labels.select(F.col("uri").alias("l_uri"), F.col("cid").alias("l_cid"), F.struct("cts", "id", "src", "val", "neg", "exp").alias("item"))
    scope = F.col("l_cid").isNull()
    scope = scope | (F.col("l_cid") == F.col("s_cid")) if key == "uri" else scope
    keys = ["s", "s_cid"] if key == "uri" else ["s"]
    lists = subjects.join(given, (F.col("l_uri") == F.col("s")) & scope).groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list("item"))).alias(column))
    match = records[key] == lists["s"]
    if key == "uri":
        match = match & records["cid"].eqNullSafe(lists["s_cid"])
    empty = F.array().cast(lists.schema[column].dataType)
    return records.join(lists, match, "left").drop(*keys).withColumn(column, F.coalesce(F.col(column), empty))


# The mark of a fatal cursor, the names of such frames with what is said where they have no message, and what is to be done.
FATAL = "FATAL_CURSOR "
FATAL_FRAMES = {"error": ("FutureCursor", "Cursor is in the future."), "info": ("OutdatedCursor", "Cursor is outside retained history.")}
RESET_HINT = "Reset subscription cursor and replay labels."


def frame_events(frames: DataFrame) -> DataFrame:
    """Events of subscriptions from frames of the label feed (subscription_url, op, name, message, ts, seq).

    op: labels, info, error, or what `subscription_states` knows already. An error FutureCursor and an info OutdatedCursor are fatal; other
    errors can be retried, other infos change nothing.
    """
    op, said = F.col("op"), F.trim(F.coalesce("message", F.lit("")))
    kind, message = op, F.col("message")
    for frame, (name, default) in FATAL_FRAMES.items():
        mine = (op == frame) & (F.col("name") == name)
        ended = F.when(said == "", default).when(said.rlike(r"[.!?]$"), said).otherwise(F.concat(said, F.lit(".")))
        kind = F.when(mine, "fatal").otherwise(kind)
        message = F.when(mine, F.concat(F.lit(f"{FATAL}{name}: "), ended, F.lit(" " + RESET_HINT))).otherwise(message)
    other = (op == "error") & F.col("name").isNotNull() & (kind == "error")
    message = F.when(other, F.concat(F.lit("labeler stream error: "), F.concat_ws(": ", "name", F.when(said != "", F.col("message"))))).otherwise(message)
    kind = F.when(kind == "labels", "event").otherwise(kind)
    return frames.select("subscription_url", kind.alias("kind"), message.alias("message"), "ts", "seq").filter("kind <> 'info'")


def subscription_states(events: DataFrame) -> DataFrame:
    """Folded state of subscriptions from (subscription_url, kind, message, ts, seq), in order of seq.

    kind: ensure, connected, event, error, fatal. Connections and events clear an error; from the first fatal mark on only another
    fatal mark changes anything. Messages keep 4096 characters.
    """
    fatal = events.groupBy("subscription_url").agg(F.min(F.when(F.col("kind") == "fatal", F.col("seq"))).alias("fatal_at"))
    live = events.join(fatal, "subscription_url").withColumn("kind", F.when(F.col("fatal_at") <= F.col("seq"), F.when(F.col("kind") == "fatal", "fatal")).otherwise(F.col("kind")))
    is_a = lambda *kinds: F.col("kind").isin(*kinds)
    last = lambda value, *kinds: F.max_by(F.when(is_a(*kinds), F.col(value)), F.when(is_a(*kinds), F.col("seq")))
    states = live.groupBy("subscription_url").agg(
        last("ts", "connected").alias("last_connected_at"),
        last("ts", "event").alias("last_event_at"),
        last("seq", "event").alias("last_seq"),
        last("seq", "connected", "event").alias("cleared_at"),
        last("seq", "error").alias("error_at"),
        F.substring(last("message", "error"), 1, 4096).alias("error"),
        last("message", "fatal").alias("fatal"),
    )
    is_open = (F.trim("error") != "") & (F.col("cleared_at").isNull() | (F.col("error_at") > F.col("cleared_at")))
    return states.withColumn("error", F.when(is_open, F.col("error"))).drop("cleared_at", "error_at")


def diagnostics(states: DataFrame, urls: DataFrame) -> DataFrame:
    """Status of each url: fatal, else error, else connected (it was connected or got an event), else pending; unknown urls are pending."""
    seen = F.col("last_connected_at").isNotNull() | F.col("last_event_at").isNotNull() | (F.coalesce("last_seq", F.lit(0)) > 0)
    status = F.when(F.col("fatal").isNotNull(), "fatal").when(F.col("error").isNotNull(), "error").when(seen, "connected").otherwise("pending")
    return urls.select("subscription_url").distinct().join(states, "subscription_url", "left").select(
        "subscription_url",
        status.alias("status"),
        F.when(F.col("fatal").isNotNull(), F.regexp_extract("fatal", r"^FATAL_CURSOR ([A-Za-z]+)", 1)).alias("error_code"),
        F.coalesce("fatal", "error").alias("message"),
        "last_connected_at",
        "last_event_at",
    )

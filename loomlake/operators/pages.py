"""Scans, lookups and keyset pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cursors import cursor, decode, timeline_cursor
from ..functions.json_values import text_at, text_in
from ..functions.times import iso_millis

SIZE, MOST, TIMELINE_SIZE = 20, 1000, 50
DIRECT = {"indexed_at", "uri", "did", "collection", "cid", "rkey", "record_created_at"}


def page_size(n: int | None) -> int:
    return SIZE if n is None or n <= 0 else min(n, MOST)


def newest(records: DataFrame, collection: str, limit: int) -> DataFrame:
    return records.filter(F.col("collection") == collection).orderBy(F.col("indexed_at").desc(), F.col("uri").desc()).limit(limit)


def by_uri(records: DataFrame, uri: str) -> DataFrame:
    return records.filter(F.col("uri") == uri)


def by_uris(records: DataFrame, uris: DataFrame) -> DataFrame:
    """Records of a table of URIs; URIs that aren't stored are missing from the result."""
    return records.join(uris.select("uri"), "uri", "left_semi")


def by_author(records: DataFrame, did: str) -> DataFrame:
    return records.filter(F.col("did") == did).orderBy(F.col("indexed_at").desc(), F.col("uri").desc())


NUMBERS = {False: "string", True: "double", "number": "double", "integer": "decimal(38,15)"}


def sort_value(field: str, numeric: bool | str = False, payload: str | None = None) -> Column:
    """A column, or a JSON field (of `payload`, if a VARIANT column holds the document): as text, or as a number with `numeric` (True or "number": double, "integer": exact)."""
    if field in DIRECT:
        return F.col(field)
    return cursor_value(field, payload).try_cast(NUMBERS[numeric])


def cursor_value(field: str, payload: str | None = None) -> Column:
    """What a cursor holds of the sort field: its text."""
    if field in DIRECT:
        return F.col(field)
    return text_at("json", *field.split(".")) if payload is None else text_in(payload, *field.split("."))


def ordered(records: DataFrame, field: str = "indexed_at", direction: str = "DESC", numeric: bool | str = False, payload: str | None = None) -> DataFrame:
    """By a field, then URI, both in one direction; nulls are smallest."""
    key = sort_value(field, numeric, payload)
    if direction not in ("ASC", "DESC"):
        raise ValueError("direction must be ASC or DESC")
    if direction == "ASC":
        return records.orderBy(key.asc_nulls_first(), F.col("uri").asc())
    return records.orderBy(key.desc_nulls_last(), F.col("uri").desc())


def beyond(key: Column, value: object, uri: str, direction: str, back: bool = False) -> Column:
    """Rows behind a cursor (before it with `back`). Rows with a null key are behind no cursor."""
    value = F.lit(value)
    less = (direction == "DESC") != back
    near = (key < value) | ((key == value) & (F.col("uri") < uri)) if less else (key > value) | ((key == value) & (F.col("uri") > uri))
    return near


@dataclass
class Page:
    """A page: lazy rows with their cursors. `taken` are the rows of one top-k with one row more than asked for, at most 1001."""

    rows: DataFrame
    taken: DataFrame
    size: int
    total: DataFrame | None
    given: bool  # a cursor was given
    back: bool

    def read(self) -> tuple[list, dict]:
        """The page's rows and its info, from one run of the sort."""
        found = self.taken.collect()
        shown = found[: self.size]
        return shown[::-1] if self.back else shown, self.about(len(found) > self.size)

    def info(self) -> dict:
        return self.about(self.taken.count() > self.size)

    def about(self, more: bool) -> dict:
        return {"hasNextPage": self.given if self.back else more, "hasPreviousPage": more if self.back else self.given}


def page(records: DataFrame, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None, field: str = "indexed_at", direction: str = "DESC", numeric: bool | str = False, with_total: bool = False, key_type: str | None = None, payload: str | None = None) -> Page:
    """One page of filtered records. `total` ignores the cursor."""
    if direction not in ("ASC", "DESC"):
        raise ValueError("direction must be ASC or DESC")
    key = sort_value(field, numeric, payload)
    back = last is not None
    given = before if back else after
    n = page_size(last if back else first)
    rows = records
    if given:
        value, uri = decode(given)
        kind = key_type or ("timestamp" if field in ("indexed_at", "record_created_at") else NUMBERS[numeric])
        rows = rows.filter(beyond(key, F.lit(value).cast(kind), uri, direction, back))
    flip = {"ASC": "DESC", "DESC": "ASC"}[direction] if back else direction
    taken = ordered(rows, field, flip, numeric, payload).limit(n + 1)
    shown = ordered(ordered(taken, field, flip, numeric, payload).limit(n), field, direction, numeric, payload) if back else taken.limit(n)
    total = records.agg(F.count(F.lit(1)).alias("total")) if with_total else None
    add = lambda df: df.withColumn("cursor", cursor(cursor_value(field, payload), F.col("uri")))
    return Page(add(shown), add(taken), n, total, bool(given), back)


def page_by_time_only(records: DataFrame, before: Column, limit: int) -> DataFrame:
    """The older form of a page: rows of the cursor's very time are skipped."""
    return records.filter(F.col("indexed_at") < before).orderBy(F.col("indexed_at").desc(), F.col("uri").desc()).limit(limit)


def timeline(scoped: DataFrame, first: int | None = None, after: str | None = None) -> DataFrame:
    """Records by created-at, newest first, of `filters.timeline_scope`, each with its `cursor`."""
    n = TIMELINE_SIZE if first is None else first
    if not 1 <= n <= MOST:
        raise ValueError(f"first must be 1 to {MOST}")
    if after:
        created, uri = decode(after)
        scoped = scoped.filter(beyond(F.col("record_created_at"), F.lit(created).cast("timestamp"), uri, "DESC"))
    rows = scoped.orderBy(F.col("record_created_at").desc(), F.col("uri").desc()).limit(n)
    return rows.withColumn("cursor", timeline_cursor(iso_millis("record_created_at"), F.col("uri")))


def page_by_id(df: DataFrame, first: int | None = None, after: int | None = None, **equal: object) -> tuple[DataFrame, DataFrame]:
    """(rows by descending id, total); the total counts what lies behind the cursor, as the page does."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == value)
    if after is not None:
        df = df.filter(F.col("id") < after)
    return df.orderBy(F.col("id").desc()).limit(page_size(first)), df.agg(F.count(F.lit(1)).alias("total"))


def actor(actors: DataFrame, did: str | None = None, handle: str | None = None) -> DataFrame:
    return actors.filter(F.col("did") == did if did is not None else F.col("handle") == handle)


def existing_actors(actors: DataFrame, dids: DataFrame) -> DataFrame:
    return dids.join(actors.select("did"), "did", "left_semi")


def event_labels(labels: DataFrame, url: str, seq: int) -> DataFrame:
    return labels.filter((F.col("subscription_url") == url) & (F.col("seq") == seq)).orderBy("label_index")

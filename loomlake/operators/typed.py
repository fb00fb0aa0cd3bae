"""Typed views of collections, driven by lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_values import blob_of, link_text, parsed_once, path_of, text_at, variant_once
from ..functions.times import iso_millis
from ..sources.lexicons import DEPTH, Catalogue

PROFILE = "app.certified.actor.profile"
# What a missing required field becomes; other types stay null.
ZEROS = {T.StringType: "", T.LongType: 0, T.BooleanType: False}


def typed_view(records: DataFrame, catalogue: Catalogue, nsid: str, coerce: bool = True) -> DataFrame:
    """The collection's fields as columns, next to uri, cid, did and rkey. `coerce` fills missing required fields.

    The JSON is parsed once. Links become their content id, blobs a struct, and a union's value stays if
    its `$type` names a member whose required fields are there; what doesn't fit is null, and of invalid JSON nothing fits.
    """
    rows = records.filter(F.col("collection") == nsid).select("uri", "cid", "did", "rkey", parsed_once("json", catalogue.schema(nsid, raw=True)).alias("s"))
    return rows.filter("s is not null").select("uri", "cid", "did", "rkey", *fields_of(F.col("s"), catalogue, nsid, coerce))


def fields_of(parsed: Column, catalogue: Catalogue, nsid: str, coerce: bool = True) -> list[Column]:
    """The collection's fields from its JSON as parsed by the catalogue's raw schema."""
    types, required = catalogue.schema(nsid), catalogue.required(nsid)
    fields = []
    for name, prop in catalogue.properties(nsid).items():
        value = shaped(parsed[name], prop, nsid, catalogue)
        fields.append((coerced(value, types[name].dataType) if coerce and name in required else value).alias(name))
    return fields


def plain(prop: dict, home: str, catalogue: Catalogue, depth: int = DEPTH) -> bool:
    """Whether values of a property are used as they are parsed."""
    kind = prop.get("type")
    if kind == "array":
        return plain(prop.get("items", {}), home, catalogue, depth)
    if kind == "ref":
        found, where = catalogue.resolve(prop["ref"], home)
        if found is None or (found.get("type") == "object" and depth <= 1):
            return True
        if found.get("type") == "object":
            return all(plain(p, where, catalogue, depth - 1) for p in found.get("properties", {}).values())
        return plain(found, where, catalogue, depth)
    return kind not in ("cid-link", "blob", "union")


def shaped(value: Column, prop: dict, home: str, catalogue: Catalogue, depth: int = DEPTH) -> Column:
    """A parsed value with its links, blobs and unions resolved, at any depth that is parsed."""
    kind = prop.get("type")
    if plain(prop, home, catalogue, depth):
        return value
    if kind == "array":
        return F.transform(value, lambda x: shaped(x, prop["items"], home, catalogue, depth))
    if kind == "ref":
        found, where = catalogue.resolve(prop["ref"], home)
        if found.get("type") != "object":
            return shaped(value, found, where, catalogue, depth)
        inner = [shaped(value[n], p, where, catalogue, depth - 1).alias(n) for n, p in found["properties"].items()]
        return F.when(value.isNotNull(), F.struct(*inner))
    if kind == "cid-link":
        return link_text(value)
    return blob_of(value) if kind == "blob" else union_value(value, catalogue.union_members(prop, home))


def coerced(value: Column, kind: T.DataType) -> Column:
    """A required field's value, with what stands for a missing one."""
    if type(kind) in ZEROS:
        return F.coalesce(value, F.lit(ZEROS[type(kind)]))
    return F.coalesce(value, F.array().cast(kind)) if isinstance(kind, T.ArrayType) else value


def union_value(value: Column, members: dict[str, list[str]] | None) -> Column:
    """A union's VARIANT if its `$type` names a member whose required fields are all there; members None: as it is."""
    if members is None:
        return value
    kind = F.try_variant_get(value, "$['$type']", "string")
    good = F.lit(False)
    for name, required in members.items():
        has = F.lit(True)
        for field in required:
            found = F.try_variant_get(value, path_of(field), "variant")
            has = has & found.isNotNull() & (F.schema_of_variant(found) != "VOID")
        good = good | ((kind == name) & has)
    return F.when(good, value)


def generic_view(records: DataFrame) -> DataFrame:
    """uri, cid, did, collection, rkey and the payload as one JSON value; rows with invalid JSON are left out."""
    return generic(records)


def generic(records: DataFrame, *more: Column) -> DataFrame:
    v = records.select("uri", "cid", "did", "collection", "rkey", variant_once("json").alias("value"), *more)
    return v.filter("value is not null")


def timeline_nodes(records: DataFrame) -> DataFrame:
    """`generic_view` with createdAt and indexedAt as text."""
    return generic(records, iso_millis("record_created_at").alias("createdAt"), iso_millis("indexed_at").alias("indexedAt"))


def single(records: DataFrame, catalogue: Catalogue, nsid: str, uri: str) -> DataFrame:
    """One record by URI, read as the asked collection, whichever it is in."""
    return typed_view(records.filter(F.col("uri") == uri).withColumn("collection", F.lit(nsid)), catalogue, nsid)


def profiles(records: DataFrame, catalogue: Catalogue | None = None, labels: str | None = None) -> DataFrame:
    """did, profile_uri, profile: each author's profile record, as a struct by its lexicon or else as text.

    labels: the column that `labels.hydrated` gave the records; it comes along as profile_labels.
    """
    own = records.filter((F.col("collection") == PROFILE) & (F.col("rkey") == "self"))
    more = [F.col(labels).alias("profile_labels")] if labels else []
    if catalogue is None:
        return own.select("did", F.col("uri").alias("profile_uri"), F.col("json").alias("profile"), *more)
    parsed = own.withColumn("s", F.from_json("json", catalogue.schema(PROFILE, raw=True))).filter("s is not null")
    profile = F.struct("uri", "cid", "rkey", *fields_of(F.col("s"), catalogue, PROFILE))
    return parsed.select("did", F.col("uri").alias("profile_uri"), profile.alias("profile"), *more)


def with_profiles(rows: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """Rows with their author's profile, null without one."""
    return rows.join(profile_rows, "did", "left")


def linked(records: DataFrame, targets: DataFrame, *path: str) -> DataFrame:
    """Records with the record they refer to (uri under `path`): forward join."""
    to = targets.select(F.col("uri").alias("target_uri"), F.col("json").alias("target_json"))
    return records.withColumn("target_uri", text_at("json", *path)).join(to, "target_uri", "left")


def linking(targets: DataFrame, records: DataFrame, *path: str) -> DataFrame:
    """uri, linked_from, linked_by of records that refer to `targets`: reverse join."""
    from_ = records.select(text_at("json", *path).alias("uri"), F.col("uri").alias("linked_from"), F.col("did").alias("linked_by"))
    return targets.select("uri").join(from_, "uri")


def same_author(records: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of records and other records of their author."""
    return records.join(others.select("did", F.col("uri").alias("other_uri"), F.col("json").alias("other_json")), "did")

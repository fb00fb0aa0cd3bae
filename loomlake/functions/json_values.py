"""Values in JSON documents: text by path, links, blobs.

`get_json_object` serves text comparisons (missing and JSON null are both null). VARIANT serves
where the JSON type or the difference between missing and null matters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_of(*names: str) -> str:
    """$.a.b for checked names."""
    for name in names:
        if not NAME.match(name):
            raise ValueError(f"not a field name: {name!r}")
    return "$" + "".join(f".{n}" for n in names)


def parsed_once(json: Column | str, schema: str | T.DataType) -> Column:
    """A row's JSON by a schema, as a generator of one row: filters on its fields then don't parse again below it."""
    return F.explode(F.array(F.from_json(_col(json), schema)))


def variant_once(json: Column | str) -> Column:
    """A row's JSON as a VARIANT, as a generator of one row (null for invalid JSON)."""
    return F.explode(F.array(variant_of(json)))


def text_at(json: Column | str, *names: str) -> Column:
    """The value as text; null when missing, JSON null or the document is invalid."""
    return F.get_json_object(_col(json), path_of(*names))


def text_in(payload: Column | str, *names: str) -> Column:
    """The same from a parsed document (VARIANT); numbers as VARIANT writes them."""
    return F.try_variant_get(_col(payload), path_of(*names), "string")


def variant_of(json: Column | str) -> Column:
    return F.try_parse_json(_col(json))


def typed_at(variant: Column | str, kind: str, *names: str) -> Column:
    """The value under a path of a VARIANT as a Spark type, null when it has another one."""
    return F.try_variant_get(_col(variant), path_of(*names), kind)


def type_at(json: Column | str, *names: str) -> Column:
    """The JSON type's name as VARIANT reports it (STRING, BIGINT, OBJECT<...>, VOID for null), null when missing."""
    return F.schema_of_variant(F.variant_get(variant_of(json), path_of(*names), "variant"))


def string_at(json: Column | str, *names: str) -> Column:
    """The value when it is a JSON string, else null."""
    return F.when(type_at(json, *names) == "STRING", text_at(json, *names))


def link_text(value: Column) -> Column:
    """A content link in a VARIANT: a string, or an object whose only key is `$link`."""
    shape = F.schema_of_variant(value)
    return F.when(shape == "STRING", F.try_variant_get(value, "$", "string")).when(
        shape == "OBJECT<`$link`: STRING>", F.try_variant_get(value, "$['$link']", "string")
    )


def link_at(json: Column | str, *names: str) -> Column:
    return link_text(F.try_variant_get(variant_of(json), path_of(*names), "variant"))


def links_at(json: Column | str, *names: str) -> Column:
    """An array of content links: bad items become null, the length stays."""
    return F.transform(F.try_variant_get(variant_of(json), path_of(*names), "array<variant>"), link_text)


def blob_at(json: Column | str, *names: str) -> Column:
    """struct<ref, mimeType, size> of a blob, null when there is none or a part is missing."""
    return blob_of(F.try_variant_get(variant_of(json), path_of(*names), "variant"))


def blob_of(v: Column) -> Column:
    """The same of a blob in a VARIANT."""
    blob = F.struct(
        link_text(F.try_variant_get(v, "$.ref", "variant")).alias("ref"),
        F.try_variant_get(v, "$.mimeType", "string").alias("mimeType"),
        F.try_variant_get(v, "$.size", "long").alias("size"),
    )
    whole = blob["ref"].isNotNull() & blob["mimeType"].isNotNull() & blob["size"].isNotNull()
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & whole, blob)

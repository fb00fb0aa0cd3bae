"""Times in records, always in UTC (the session's zone must be UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_values import string_at, text_at, type_at

# Fields tried in this order, and the forms of times: RFC 3339 (a zone is a must), and those that are read besides it
# (a T without a zone, or a blank with or without whole hours of a zone).
CREATED_FIELDS = ("createdAt", "$createdAt", "created_at", "timestamp", "indexedAt")
STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
LENIENT = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?| \d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2})?)$"
DAY = r"^\d{4}-\d{2}-\d{2}$"


def parsed(text: Column) -> Column:
    """The time of a text in one of the known forms, in UTC where it names no zone; other texts (a year, a time of day, a bare date) give null."""
    return F.when(text.rlike(LENIENT), F.try_to_timestamp(text))


def strict(text: Column) -> Column:
    """The time of a text in RFC 3339, else null."""
    return F.when(text.rlike(STRICT), F.try_to_timestamp(text))


def day_of(text: Column) -> Column:
    """The day (UTC) of a text that `parsed` reads or that is a bare date."""
    return F.to_date(F.when(text.rlike(DAY) | text.rlike(LENIENT), F.try_to_timestamp(text)))


def normalised_created_at(json: Column | str) -> Column:
    """Top-level createdAt: a string in RFC 3339 with a zone other than -00:00, cut to milliseconds; else null."""
    text = string_at(json, "createdAt")
    return F.when(~text.endswith("-00:00"), F.date_trunc("MILLISECOND", strict(text)))


def extracted_created_at(json: Column | str, fallback: Column) -> Column:
    """The first field that holds a readable time, else `fallback`."""
    json = F.col(json) if isinstance(json, str) else json
    tried = []
    for field in CREATED_FIELDS:
        if field.startswith("$"):
            value = F.try_variant_get(F.try_parse_json(json), f"$['{field}']", "variant")
            tried.append(parsed(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))))
        else:
            tried.append(parsed(F.when(type_at(json, field) == "STRING", text_at(json, field))))
    return F.coalesce(*tried, fallback)


def iso_millis(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

"""Page cursors: base64url JSON, as columns for rows and as plain values for the caller."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c.cast("binary")), "+/\n\r", "-_"), F.lit("="))


def cursor(*values: Column) -> Column:
    """The cursor of a row: its sort values and URI as a JSON array of strings (null: '')."""
    return _url(F.to_json(F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values])))


def timeline_cursor(created_at: Column, uri: Column) -> Column:
    return _url(F.to_json(F.struct(F.lit(1).alias("v"), created_at.cast("string").alias("createdAt"), uri.alias("uri"))))


def decode(text: str) -> list[str]:
    """Values of a cursor; a cursor of the older form, parted by |, is read as well."""
    try:
        data = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode()
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if data.startswith("["):
        return [str(x) for x in json.loads(data)]
    if data.startswith("{"):
        found = json.loads(data)
        if found.get("v") != 1 or not found.get("createdAt") or not found.get("uri"):
            raise ValueError("invalid cursor")
        return [found["createdAt"], found["uri"]]
    if "|" in data:
        return data.split("|", 1)
    raise ValueError("invalid cursor")

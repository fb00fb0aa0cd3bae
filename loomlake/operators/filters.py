"""Filters over records: a `where` dictionary becomes one Column, label and custom filters become joins.

    {"title": {"contains": "x"}, "score": {"gte": 3}, "did": {"in": [...]}, "uri": {"eq": ...},
     "subject.uri": {"eq": ...}, "items": {"any": {"itemIdentifier.uri": {"eq": ...}}},
     "externalLabels": {"has": {...}, "none": {...}}, "authorLabels": {...}}

Missing and JSON null both count as null; a null never equals or differs from anything.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json_values import path_of, text_at, text_in, variant_of
from ..functions.uris import valid_nsid
from ..sources.lexicons import merged_fields as merged_union_fields  # noqa: F401
from . import labels as L

MOST_VALUES, MOST_CONDITIONS, MOST_DEPTH = 100, 20, 3
# The operators of each field type.
OPERATORS = {
    "string": {"eq", "neq", "in", "contains", "startsWith", "isNull"},
    "integer": {"eq", "neq", "gt", "lt", "gte", "lte", "in", "isNull"},
    "number": {"eq", "neq", "gt", "lt", "gte", "lte", "isNull"},
    "boolean": {"eq", "isNull"},
    "datetime": {"eq", "neq", "gt", "lt", "gte", "lte", "isNull"},
    "presence": {"isNull"},
    "nested": {"eq", "in", "isNull"},
}
DIRECT = {"uri", "cid", "collection", "rkey"}

#: (collection, field) -> function (records, op, value) -> records; see `register_filter`.
EXTENSIONS: dict[tuple[str, str], Callable[[DataFrame, str, object], DataFrame]] = {}


def register_filter(collection: str, field: str, apply: Callable[[DataFrame, str, object], DataFrame]) -> None:
    EXTENSIONS[collection, field] = apply


def compare(value: Column, op: str, wanted: object) -> Column:
    """One comparison. Lists hold at most 100 values; an empty list matches nothing."""
    if op == "in":
        if len(wanted) > MOST_VALUES:
            raise ValueError(f"more than {MOST_VALUES} values")
        return value.isin(list(wanted)) if wanted else F.lit(False)
    if op == "isNull":
        return value.isNull() if wanted else value.isNotNull()
    if op in ("contains", "startsWith"):
        test = F.contains if op == "contains" else F.startswith
        return test(F.lower(value), F.lower(F.lit(wanted)))
    return {"eq": value.__eq__, "neq": value.__ne__, "gt": value.__gt__, "lt": value.__lt__, "gte": value.__ge__, "lte": value.__le__}[op](F.lit(wanted))


def field_value(kind: str, text: Column, instants: bool = False) -> Column:
    """A JSON text as the field's type; times compare as text unless `instants` is set. Integers compare exactly, also beyond 2^53."""
    if kind == "integer":
        return text.try_cast("decimal(38,15)")
    if kind == "number":
        return text.try_cast("double")
    if kind == "boolean":
        return text.try_cast("boolean")
    return F.try_to_timestamp(text) if kind == "datetime" and instants else text


def condition(field: str, kind: str, op: str, wanted: object, json: str = "json", instants: bool = False, parsed: Column | None = None, payload: str | None = None) -> Column:
    """`field op wanted` for a top-level field, a path of up to three levels (a.b.c), or a column of its own.

    parsed: the fields' texts as a struct, where the JSON has been parsed already; payload: a VARIANT column that holds the document.
    """
    names = field.split(".")
    if len(names) > MOST_DEPTH:
        raise ValueError(f"{field}: more than {MOST_DEPTH} levels")
    allowed = OPERATORS["nested"] if len(names) > 1 else OPERATORS.get(kind, OPERATORS["presence"])
    if op not in allowed:
        raise ValueError(f"{field}: no operator {op} for {kind}")
    if field in DIRECT:
        return compare(F.col(field), op, wanted)
    if payload is not None:
        value = text_in(payload, *names)
    else:
        value = text_at(json, *names) if parsed is None else reduce(lambda c, n: c[n], names, parsed)
    if op == "isNull":
        return compare(value, op, wanted)
    if kind == "datetime" and instants:
        wanted = F.try_to_timestamp(F.lit(wanted))
    return compare(field_value(kind, value, instants), op, wanted)


def any_element(field: str, tests: dict[str, dict[str, object]], json: str = "json", payload: str | None = None) -> Column:
    """Whether one element of an array passes all tests; the empty path '' is the element itself."""
    items = F.try_variant_get(variant_of(json) if payload is None else F.col(payload), path_of(*field.split(".")), "array<variant>")

    def passes(x: Column) -> Column:
        parts = []
        for path, ops in tests.items():
            value = F.try_variant_get(x, path_of(*path.split(".")) if path else "$", "string")
            for op, wanted in ops.items():
                if op not in OPERATORS["nested"]:
                    raise ValueError(f"{field}.{path}: no operator {op}")
                parts.append(compare(value, op, wanted))
        return reduce(Column.__and__, parts, F.lit(True))

    return F.coalesce(F.exists(items, passes), F.lit(False))


def author_condition(ops: dict[str, object]) -> Column:
    """eq wins over in; an empty list filters nothing."""
    if "eq" in ops:
        return F.col("did") == ops["eq"]
    wanted = ops.get("in") or []
    if len(wanted) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values")
    return F.col("did").isin(list(wanted)) if wanted else F.lit(True)


def texts_of(paths: list[str]) -> T.StructType | None:
    """A schema that reads the paths of a JSON document as text; None where one path lies in another or names differ in case only."""
    tree: dict = {}
    for path in paths:
        at = tree
        *above, last = path.split(".")
        for name in above:
            at = at.setdefault(name, {})
            if not isinstance(at, dict):
                return None
        if at.setdefault(last, "") != "":
            return None

    def struct(names: dict) -> T.StructType | None:
        inner = {n: T.StringType() if x == "" else struct(x) for n, x in names.items()}
        if len({n.lower() for n in names}) < len(names) or None in inner.values():
            return None
        return T.StructType([T.StructField(n, kind) for n, kind in inner.items()])

    return struct(tree)


def column_of(where: dict, fields: dict[str, str], instants: bool = False, payload: str | None = None) -> Column:
    """All conditions of `where` on the record itself, joined by and. At most 20 count (authors and labels don't).

    With two fields or more the JSON is parsed once for all of them: the conditions are a test on the one element of an array.
    With `payload`, a VARIANT column, nothing is parsed.
    """
    parts, texts, n = [], [], 0
    for field, ops in where.items():
        if field in ("externalLabels", "authorLabels"):
            continue
        if field == "did":
            parts.append(author_condition(ops))
            continue
        if "any" in ops:
            parts.append(any_element(field, ops["any"], payload=payload))
            n += sum(len(o) for o in ops["any"].values())
            continue
        for op, wanted in ops.items():
            test = (field, fields.get(field, "string" if field in DIRECT or "." in field else "presence"), op, wanted)
            parts.append(condition(*test, instants=instants, payload=payload))  # also checks the test
            if field not in DIRECT:
                parts.pop()
                texts.append(test)
            n += 1
    if n > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions")
    paths = list(dict.fromkeys(t[0] for t in texts))
    schema = texts_of(paths) if len(paths) > 1 and payload is None else None
    if schema is None:
        parts += [condition(*t, instants=instants, payload=payload) for t in texts]
    else:
        tests = lambda s: reduce(Column.__and__, [condition(*t, instants=instants, parsed=s) for t in texts])
        parts.append(F.exists(F.array(F.from_json("json", schema)), tests))
    return reduce(Column.__and__, parts, F.lit(True))


def label_condition(ops: dict[str, dict[str, object]]) -> Column:
    """Text filters on a label's src and val."""
    return reduce(Column.__and__, [compare(F.col(c), op, v) for c in ("src", "val") for op, v in ops.get(c, {}).items()], F.lit(True))


def by_labels(records: DataFrame, labels: DataFrame, where: dict, as_of: Column) -> DataFrame:
    """has / none filters on the record's and its author's labels, active ones unless activeOnly is false."""
    for key, join in (("externalLabels", L.by_record_label), ("authorLabels", L.by_author_label)):
        for side in ("has", "none"):
            ops = where.get(key, {}).get(side)
            if ops is not None:
                found = L.active(labels, as_of) if ops.get("activeOnly", True) else labels
                records = join(records, found.filter(label_condition(ops)), side == "has")
    return records


def where(records: DataFrame, tests: dict, fields: dict[str, str], labels: DataFrame | None = None, as_of: Column | None = None, collection: str | None = None, instants: bool = False, payload: str | None = None) -> DataFrame:
    """`records` that pass all of `tests`. payload: a VARIANT column that holds the document, as `record_store` keeps it."""
    own = {f: o for f, o in tests.items() if (collection, f) not in EXTENSIONS}
    found = records.filter(column_of(own, fields, instants, payload))
    for field, ops in tests.items():
        if (collection, field) in EXTENSIONS:
            for op, wanted in ops.items():
                found = EXTENSIONS[collection, field](found, op, wanted)
    return found if labels is None else by_labels(found, labels, tests, as_of)


def search(records: DataFrame, text: str, collection: str | None = None, normalised: bool = False) -> DataFrame:
    """Records whose JSON text holds `text`, in any case; keys count too, and blanks count as letters. `normalised` re-renders the JSON first."""
    if len(text) < 3:
        raise ValueError("search for at least three characters")
    found = records.filter(F.col("collection") == collection) if collection else records
    json = F.to_json(variant_of("json")) if normalised else F.col("json")
    return found.filter(F.contains(F.lower(json), F.lower(F.lit(text))))


def timeline_scope(records: DataFrame, collections: list[str], authors: list[str] | DataFrame | None = None, most_collections: int = 25, most_authors: int = 1000) -> DataFrame:
    """Records of 1 to 25 collections and, if given, of some authors; an empty list of authors gives no rows."""
    if not 1 <= len(collections) <= most_collections or not all(valid_nsid(c) for c in collections):
        raise ValueError(f"1 to {most_collections} valid collections")
    found = records.filter(F.col("collection").isin(collections) & F.col("record_created_at").isNotNull())
    if authors is None:
        return found
    if isinstance(authors, DataFrame):
        return found.join(authors.select("did").distinct(), "did", "left_semi")
    if len(authors) > most_authors:
        raise ValueError(f"more than {most_authors} authors")
    return found.filter(F.col("did").isin(authors)) if authors else found.limit(0)


def contributor_did(identities: DataFrame, field: str = "contributors") -> Callable[[DataFrame, str, object], DataFrame]:
    """A filter on an array of contributors: an item is a DID, names one, or links to a record whose `identifier` is one.

    identities: uri, json of contributor records.
    """

    def apply(records: DataFrame, op: str, wanted: object) -> DataFrame:
        dids = [wanted] if op == "eq" else list(wanted)
        if op not in ("eq", "in") or len(dids) > MOST_VALUES:
            raise ValueError("contributorDid: eq or in, at most 100 values")
        item = F.explode(F.try_variant_get(variant_of("json"), path_of(field), "array<variant>"))
        x = lambda path: F.try_variant_get("item", path, "string")
        bare = F.when(F.schema_of_variant("item") == "STRING", x("$"))
        items = records.select("uri", item.alias("item")).select(
            "uri",
            F.array_compact(F.array(bare, x("$.identity"), x("$.contributorIdentity.identity"), x("$.contributorIdentity.did"))).alias("dids"),
            F.coalesce(x("$.uri"), x("$.contributorIdentity.uri")).alias("link"),
        )
        named = items.filter(F.arrays_overlap("dids", F.array(*[F.lit(d) for d in dids]))).select("uri") if dids else items.limit(0).select("uri")
        known = identities.filter(text_at("json", "identifier").isin(dids)).select(F.col("uri").alias("link"))
        linked = items.join(known, "link", "left_semi").select("uri")
        return records.join(named.unionByName(linked).distinct(), "uri", "left_semi")

    return apply


def badge_type(definitions: DataFrame) -> Callable[[DataFrame, str, object], DataFrame]:
    """A filter on awards by the badgeType of the definition they refer to. definitions: uri, json."""

    def apply(records: DataFrame, op: str, wanted: object) -> DataFrame:
        types = definitions.select(F.col("uri").alias("__badge"), text_at("json", "badgeType").alias("__type"))
        joined = records.withColumn("__badge", text_at("json", "badge", "uri")).join(types, "__badge", "left")
        return joined.filter(compare(F.col("__type"), op, wanted)).drop("__badge", "__type")

    return apply

"""Lexicon files: record schemas as data, turned into Spark types on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import types as T

# Names that record fields can't take, and scalar types.
RESERVED = ("uri", "cid", "did", "rkey", "externalLabels", "authorLabels", "certifiedProfileData")
SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.StringType(), "cid-link": T.StringType()}
BLOB = T.StructType([T.StructField("ref", T.StringType()), T.StructField("mimeType", T.StringType()), T.StructField("size", T.LongType())])
DEPTH = 3


def merged_fields(members: list[dict[str, str]]) -> dict[str, str]:
    """Fields of a union that can be filtered: those whose type is the same in every member that has them."""
    found: dict[str, str | None] = {}
    for fields in members:
        for name, kind in fields.items():
            found[name] = kind if found.get(name, kind) == kind else None
    return {name: kind for name, kind in found.items() if kind}


class Catalogue:
    """Lexicons by NSID."""

    def __init__(self, lexicons: list[dict]):
        self.lexicons = {x["id"]: x for x in lexicons}

    @classmethod
    def read(cls, folder: str) -> Catalogue:
        return cls([json.loads(p.read_text()) for p in sorted(Path(folder).rglob("*.json"))])

    def collections(self) -> list[str]:
        return sorted(i for i, x in self.lexicons.items() if x.get("defs", {}).get("main", {}).get("type") == "record")

    def record(self, nsid: str) -> dict:
        main = self.lexicons[nsid]["defs"]["main"]
        return main["record"] if main["type"] == "record" else main

    def resolve(self, ref: str, home: str) -> tuple[dict | None, str]:
        """(definition, its lexicon's NSID) of a reference: nsid, nsid#name or #name."""
        nsid, _, name = ref.partition("#")
        nsid = nsid or home
        return self.lexicons.get(nsid, {}).get("defs", {}).get(name or "main"), nsid

    def type_of(self, prop: dict, home: str, depth: int = DEPTH, raw: bool = False) -> T.DataType:
        """Unresolved references are strings; unions, inline objects and what lies too deep stay VARIANT.

        raw: the type to parse JSON as, with links and blobs as VARIANT (see operators/typed.py).
        """
        kind = prop.get("type")
        if raw and kind in ("cid-link", "blob"):
            return T.VariantType()
        if kind == "array":
            return T.ArrayType(self.type_of(prop.get("items", {}), home, depth, raw))
        if kind == "ref":
            found, where = self.resolve(prop["ref"], home)
            if found is None:
                return T.StringType()
            if found.get("type") == "object":
                return self.struct_of(found, where, depth - 1, raw) if depth > 1 else T.VariantType()
            return self.type_of(found, where, depth, raw)
        if kind == "blob":
            return BLOB
        if kind in ("union", "object", "unknown"):
            return T.VariantType()
        return SCALARS.get(kind, T.StringType())

    def struct_of(self, definition: dict, home: str, depth: int = DEPTH, raw: bool = False) -> T.DataType:
        fields = [T.StructField(n, self.type_of(p, home, depth, raw)) for n, p in definition.get("properties", {}).items()]
        return T.StructType(fields) if fields else T.VariantType()

    def properties(self, nsid: str) -> dict[str, dict]:
        """The collection's properties, without those whose names are reserved."""
        return {n: p for n, p in self.record(nsid).get("properties", {}).items() if n not in RESERVED}

    def schema(self, nsid: str, raw: bool = False) -> T.StructType:
        """The collection's fields."""
        return T.StructType([T.StructField(n, self.type_of(p, nsid, DEPTH, raw)) for n, p in self.properties(nsid).items()])

    def required(self, nsid: str) -> list[str]:
        return [n for n in self.record(nsid).get("required", []) if n not in RESERVED]

    def filter_fields(self, nsid: str) -> dict[str, str]:
        """Field or path -> type of filter (operators/filters.py).

        The top level by type; below it the paths through references and unions, up to three levels. A
        union's fields are those of its members; where members differ in a field's type, it can't be filtered.
        """
        return self.fields_of(self.record(nsid), nsid)

    def fields_of(self, definition: dict, home: str, depth: int = DEPTH) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, prop in definition.get("properties", {}).items():
            kind = prop.get("type")
            out[name] = "datetime" if prop.get("format") == "datetime" else kind if kind in ("string", "integer", "number", "boolean") else "presence"
            if depth > 1 and kind in ("ref", "union"):
                found = [self.resolve(r, home) for r in ([prop["ref"]] if kind == "ref" else prop.get("refs", []))]
                inner = merged_fields([self.fields_of(d, where, depth - 1) for d, where in found if d and d.get("type") == "object"])
                out |= {f"{name}.{path}": k for path, k in inner.items()}
        return out

    def union_members(self, prop: dict, home: str) -> dict[str, list[str]] | None:
        """$type -> required fields of a union's members; null when one can't be resolved."""
        out = {}
        for ref in prop.get("refs", []):
            found, where = self.resolve(ref, home)
            if found is None:
                return None
            name = ref if not ref.startswith("#") else where + ref
            out[name] = found.get("required", [])
        return out

"""Record URIs, collection names and DIDs as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings.
_SEGMENT = r"[\p{Ll}\p{Nd}]([\p{Ll}\p{Nd}-]*[\p{Ll}\p{Nd}])?"
NSID = rf"^{_SEGMENT}(\.{_SEGMENT}){{2,}}$"
DID = r"^did:(plc|web):[A-Za-z0-9._:%-]*[A-Za-z0-9._-]$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_uri(did: Column | str, collection: Column | str, rkey: Column | str) -> Column:
    """at://did/collection/rkey."""
    return F.concat(F.lit("at://"), _col(did), F.lit("/"), _col(collection), F.lit("/"), _col(rkey))


def rkey_of(uri: Column | str) -> Column:
    """The text behind the last slash; null when there is none."""
    last = F.element_at(F.split(_col(uri), "/"), -1)
    return F.when(last != "", last)


def did_of(uri: Column | str) -> Column:
    return F.regexp_extract(_col(uri), r"^at://([^/]+)", 1)


def collection_of(uri: Column | str) -> Column:
    return F.regexp_extract(_col(uri), r"^at://[^/]+/([^/]+)", 1)


def is_valid_did(did: Column | str) -> Column:
    return F.coalesce(_col(did).rlike(DID), F.lit(False))


def is_loose_did(did: Column | str) -> Column:
    """Starts with `did:` and has no blank."""
    c = _col(did)
    return F.coalesce(c.startswith("did:") & (F.length(c) > 4) & ~c.contains(" "), F.lit(False))


def is_valid_nsid(nsid: Column | str) -> Column:
    """Three segments or more of lower-case letters, digits and hyphens; none starts or ends with a hyphen."""
    return F.coalesce(_col(nsid).rlike(NSID), F.lit(False))


def valid_nsid(nsid: str) -> bool:
    """The rule of `is_valid_nsid` for one name."""
    part = lambda p: bool(p) and all(unicodedata.category(c) in ("Ll", "Nd") or c == "-" for c in p) and "-" not in (p[0], p[-1])
    return nsid.count(".") >= 2 and all(map(part, nsid.split(".")))


def nsid_name(nsid: Column | str) -> Column:
    """The last segment."""
    return F.element_at(F.split(_col(nsid), r"\."), -1)


def nsid_domain(nsid: Column | str) -> Column:
    """All segments but the last."""
    parts = F.split(_col(nsid), r"\.")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ".")


def nsid_type_name(nsid: Column | str) -> Column:
    """PascalCase of all segments: app.fixture.click -> AppFixtureClick."""
    return F.array_join(F.transform(F.split(_col(nsid), r"[.-]"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000))), "")


def nsid_field_name(nsid: Column | str) -> Column:
    """camelCase of all segments: app.fixture.click -> appFixtureClick."""
    name = nsid_type_name(nsid)
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 10_000))


def in_namespace(collection: Column | str, wanted: list[str]) -> Column:
    """Whether a collection is wanted; `app.x.*` stands for all of a namespace."""
    c = _col(collection)
    exact = [w for w in wanted if not w.endswith("*")]
    found = c.isin(exact) if exact else F.lit(False)
    for w in wanted:
        if w.endswith("*"):
            found = found | c.startswith(w[:-1])
    return found

"""Secret scans with DataFrame functions only.

Base findings come from three patterns (assigned values, access keys, hexadecimal strings). The
method adds spans of high entropy: each candidate string, a long run of one character class, is
read once by a sliding window; a character that enters or leaves changes two counts and the
window's sum of c*log2(c), which is its Shannon entropy but for constants. Windows whose entropy
reaches the class's threshold are merged into spans. The allow-list (texts that only look random)
suppresses windows less than a window's length away from a match, so a sample key goes as a whole and the rest of
a long run is still scanned. Sums use integers (2**-20 bits), so no rounding differs between engines.

All work happens inside the row: no shuffle, no Python on the executors. Positions are code points.

Defined cases: null and empty texts have no findings; a very long text is scanned whole; at one start spans are in the
order of their kinds; repeated rows and rows without an
id are scanned like others; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The patterns of the base findings; (kind, pattern, group, least characters of it).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # Runs that are too short can be skipped by the pattern itself: a run is never cut.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What stands around one of these is no secret: counting-up samples, documentation keys, fillers.
ALLOW = r"(?i)0123456789|abcdefgh|example|sample|placeholder|changeme|xxxxxxxx"
UNIT = 1 << 20


@dataclass(frozen=True)
class CharClass:
    """A character class, its window in characters, and the least entropy of a window in bits."""

    name: str
    regex: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"[{self.regex}]{{{self.window},}}"

    @property
    def limit(self) -> int:
        """The largest sum of c*log2(c), in units, of a window with enough entropy."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", DIGITS + UPPER[:6] + LOWER[:6], 20, 3.0),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", DIGITS + UPPER + LOWER + "+/_=-", 24, 4.1),
)
SPANS = "array<struct<start int, no int, kind string, end int>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def starts_of(pieces: Column, matches: Column, block: int = 256) -> Column:
    """Where each match starts. Sums go by blocks, so many matches don't cost their square."""
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))

    def within(steps: Column, heads: Column) -> Column:
        sums = F.transform(heads, lambda h: total(F.slice(steps, h + 1, block)))
        return bound(
            sums,
            lambda sums: F.flatten(
                F.transform(
                    heads,
                    lambda h, k: bound(
                        F.struct(total(F.slice(sums, 1, k)).alias("base"), F.slice(steps, h + 1, block).alias("own")),
                        lambda b: F.transform(b["own"], lambda _, j: b["base"] + total(F.slice(b["own"], 1, j))),
                    ),
                )
            ),
        )

    before = bound(steps, lambda s: bound(F.sequence(F.lit(0), F.size(s) - 1, F.lit(block)), lambda h: within(s, h)))
    return F.zip_with(before, F.slice(pieces, 1, F.size(matches)), lambda b, p: b + F.length(p))


def matches_of(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, found, value>> of the leftmost non-overlapping matches."""
    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")).alias("value"),
    )
    return bound(
        found,
        lambda f: F.arrays_zip(
            starts_of(f["pieces"], f["found"]).alias("start"), f["found"].alias("found"), (f["value"] if group else f["found"]).alias("value")
        ),
    )


def base_spans(text: Column, no: int) -> Column:
    kind, pattern, group, least = BASE[no]
    kept = F.filter(matches_of(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    spans = F.transform(
        kept,
        lambda m: F.struct(
            m["start"].cast("int").alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["found"])).cast("int").alias("end")
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.expr(f"cast(array() as {SPANS})"))


def hot_windows(codes: Column, kind: CharClass) -> Column:
    """array<struct<start, end>>: merged windows of enough entropy in an array of alphabet indexes."""
    w = kind.window
    logs = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(w + 1)])
    log = lambda c: F.element_at(logs, c + 1)
    ranges = "array<struct<start int, end int>>"
    zero = F.struct(
        F.array_repeat(F.lit(0), len(kind.alphabet)).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.expr(f"cast(array() as {ranges})").alias("done"),
    )

    def step(state: Column, i: Column) -> Column:
        """i: the place, from 1, of the character that enters."""
        enters = F.element_at(codes, i)
        leaves = F.when(i > w, F.element_at(codes, F.greatest(i - w, F.lit(1)))).otherwise(F.lit(0))
        counts, more = state["counts"], F.element_at(state["counts"], enters)
        less = F.when(leaves > 0, F.element_at(counts, F.greatest(leaves, F.lit(1)))).otherwise(F.lit(1))
        changed = F.when(enters == leaves, state["sum"]).otherwise(state["sum"] + log(more + 1) - log(more) + log(less - 1) - log(less))
        moved = F.when(enters == leaves, counts).otherwise(
            F.transform(counts, lambda c, k: c + F.when(k + 1 == enters, 1).when(k + 1 == leaves, -1).otherwise(0))
        )
        done, start = state["done"], (i - w).cast("int")
        last = F.try_element_at(done, F.lit(-1))
        grown = F.when(
            (F.size(done) > 0) & (start <= last["end"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), i.cast("int").alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(start.alias("start"), i.cast("int").alias("end")))))
        return bound(
            changed,
            lambda s: F.struct(moved.alias("counts"), s.alias("sum"), F.when((i >= w) & (s <= kind.limit), grown).otherwise(done).alias("done")),
        )

    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda s: s["done"])


def outside(found: Column, allow: str, reach: int) -> Column:
    """array<struct<start, found>>: the parts of a text that are at least `reach` characters away from each match of `allow`."""

    def parts(f: Column) -> Column:
        hits, n = f["hits"], F.size(f["hits"])
        return bound(
            starts_of(f["pieces"], hits),
            lambda at: F.transform(
                f["pieces"],
                lambda piece, j: bound(
                    F.struct(F.when(j > 0, reach).otherwise(0).alias("left"), F.when(j < n, reach).otherwise(0).alias("right"), F.greatest(j, F.lit(1)).alias("hit")),
                    lambda cut: F.struct(
                        (F.when(j > 0, F.element_at(at, cut["hit"]) + F.length(F.element_at(hits, cut["hit"]))).otherwise(0) + cut["left"]).cast("int").alias("start"),
                        F.substring(piece, cut["left"] + 1, F.greatest(F.length(piece) - cut["left"] - cut["right"], F.lit(0))).alias("found"),
                    ),
                ),
            ),
        )

    split = F.struct(F.split(found, allow, -1).alias("pieces"), F.regexp_extract_all(found, F.lit(allow), F.lit(0)).alias("hits"))
    return F.when(F.regexp_like(found, F.lit(allow)), bound(split, parts)).otherwise(F.array(F.struct(F.lit(0).alias("start"), found.alias("found"))))


def entropy_spans(text: Column, kind: CharClass, no: int, allow: str) -> Column:
    place = F.create_map(*[x for k, c in enumerate(kind.alphabet) for x in (F.lit(c), F.lit(k + 1))])

    def of_part(start: Column, part: Column) -> Column:
        return bound(
            F.transform(F.split(part["found"], ""), lambda c: F.element_at(place, c)),
            lambda codes: F.transform(
                hot_windows(codes, kind),
                lambda r: F.struct((start + r["start"]).cast("int").alias("start"), F.lit(no).alias("no"), F.lit(kind.name).alias("kind"), (start + r["end"]).cast("int").alias("end")),
            ),
        )

    spans = F.flatten(
        F.transform(
            matches_of(text, kind.pattern),
            lambda m: F.flatten(
                F.transform(F.filter(outside(m["found"], allow, kind.window), lambda x: F.length(x["found"]) >= kind.window), lambda x: of_part(m["start"] + x["start"], x))
            ),
        )
    )
    return F.when(F.regexp_like(text, F.lit(kind.pattern)), spans).otherwise(F.expr(f"cast(array() as {SPANS})"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: str = ALLOW) -> DataFrame:
    """doc_id, base and added (arrays of start, no, kind, end) for every row of `docs`."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.select(
        "doc_id",
        *[base_spans(text, no).alias(f"base_{k[0]}") for no, k in enumerate(BASE)],
        F.concat(*[entropy_spans(text, k, len(BASE) + n, allow) for n, k in enumerate(classes)]).alias("added"),
    ).select("doc_id", F.array_sort(F.concat(*[f"base_{k[0]}" for k in BASE])).alias("base"), F.array_sort("added").alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base findings, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k[0]).alias(f"n_{k[0]}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )

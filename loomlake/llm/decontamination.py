"""Benchmark decontamination with Aho-Corasick automata.

Texts are lower-cased (A-Z) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Every run
of `window` consecutive words of a benchmark text is a pattern; a text of fewer words is one
pattern. An automaton over the patterns reads each normalised document once; hits are mapped
back to word positions and, in `spans`, to code points of the original text.

Documents are read once and nothing is shuffled. A worker builds the automaton once, for all its tasks. Over `at_once` words of benchmark it would be too
large for that: then a batch's words are first looked up by 64-bit keys of their windows (eight bytes for each of the benchmark), and
the automaton holds the patterns whose keys the batch has, which it confirms word by word.

What is sent to the workers is bounded by `block_words` words of benchmark (longer texts than `longest`
words are cut into overlapping parts of that length, which have the same
windows). Only beyond that the benchmark is cut into blocks of so many words: the blocks' hits are then written one block after the other, and documents that
have some are put together by id and digest.

Defined cases: a very long text is scanned whole; null and wordless texts have no words, hits or items; wordless items never occur;
repeated items each count with their own id, rows that repeat an item id and text once; items
without an id are left out; an empty table of documents gives no rows, an empty benchmark no hits;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, portable, shared_dir, stored

portable(__name__)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII letters in lower case, digits and all bytes of other characters stay, the rest parts words.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def spelled(words: list[bytes]) -> str:
    """Words with a blank on both sides of each, a character for each byte."""
    return b" ".join((b"", *words, b"")).decode("latin-1")


def windows_of(words: list[bytes], window: int) -> set[str]:
    if not words:
        return set()
    return {spelled(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton_of(owners: dict[str, set[int]]):
    """Automaton over spelled windows, whose values are (words, indexes of items)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w, ks in owners.items():
        found.add_word(w, (w.count(" ") - 1, tuple(ks)))
    if owners:
        found.make_automaton()
    return found


#: Odd multiplier that parts the places of a window.
PLACE = 0x9E3779B97F4A7C15


def keys_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each run of n words."""
    size = len(hashes) - n + 1
    out = np.zeros(max(size, 0), np.uint64)
    if size > 0:
        for j in range(n):
            out += hashes[j : j + size] * np.uint64(pow(PLACE, j + 1, 1 << 64))
    return out


class Patterns:
    """Some items' windows as a worker keeps them; built when first asked for."""

    def __init__(self, items: list[tuple[str, str]], window: int, at_once: int):
        self.items, self.window, self.at_once = items, window, at_once
        self.built = False

    def build(self) -> None:
        words = [words_of(text) for _, text in self.items]
        self.small = sum(map(len, words)) <= self.at_once
        if self.small:
            owners: dict[str, set[int]] = {}
            for k, w in enumerate(words):
                for spelling in windows_of(w, self.window):
                    owners.setdefault(spelling, set()).add(k)
            self.automaton = automaton_of(owners)
        else:
            self.words = words
            self.hashes = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "big") | 1 for w in {w for ws in words for w in ws}}
            held: dict[int, list] = {}
            for k, w in enumerate(words):
                if w:
                    n = min(self.window, len(w))
                    keys = keys_of(self.hashed(w), n)
                    held.setdefault(n, []).append((keys, np.full(len(keys), k), np.arange(len(keys))))
            self.keys = {}
            for n, parts in held.items():
                keys, item, start = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys)
                self.keys[n] = keys[order], item[order].astype(np.int32), start[order].astype(np.int32)
        self.built = True

    def hashed(self, words: list[bytes]) -> np.ndarray:
        """64 bits of each word; 0 for words that no item has."""
        get = self.hashes.get
        return np.array([get(w, 0) for w in words], np.uint64)

    def automata(self, texts: list[list[bytes]]) -> list:
        """For each of a batch's texts the automaton to read it with, None if no window can occur."""
        if not self.built:
            self.build()
        if self.small:
            return [self.automaton if len(self.automaton) and words else None for words in texts]
        owners: dict[str, set[int]] = {}
        may = [False] * len(texts)
        for t, words in enumerate(texts):
            hashes = self.hashed(words)
            for n, (keys, item, start) in self.keys.items():
                mine = np.unique(keys_of(hashes, n))
                at = np.searchsorted(keys, mine)
                hit = mine[keys[np.minimum(at, len(keys) - 1)] == mine]
                for low, high in zip(np.searchsorted(keys, hit), np.searchsorted(keys, hit, "right"), strict=True):
                    may[t] = True
                    for k, i in zip(item[low:high].tolist(), start[low:high].tolist(), strict=True):
                        owners.setdefault(spelled(self.words[k][i : i + n]), set()).add(k)
        automaton = automaton_of(owners)
        return [automaton if m else None for m in may]


def scan(automaton, words: list[bytes]):
    """Word ranges [start, end) of hits, merged, and the indexes of the items that occur."""
    found = list(automaton.iter(spelled(words)))
    if not found:
        return [], ()
    stops, at = {}, 0  # the blank behind each word, by its place
    for i, w in enumerate(words):
        at += len(w) + 1
        stops[at] = i + 1
    ranges, items = [], set()
    for start, stop in sorted({(stops[end] - n, stops[end]) for end, (n, _) in found}):
        if ranges and start <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], stop)
        else:
            ranges.append([start, stop])
    for _, (_, ks) in found:
        items.update(ks)
    return ranges, items


def scanned(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, hits (word ranges), spans (code points), items (ids) against some items. sent: the broadcast of their Patterns."""

    def make():
        import pyarrow as pa

        patterns, word = sent.value, re.compile(WORD)
        ids = [i for i, _ in patterns.items]

        def step(batch):
            n_words, hits, spans, names = [], [], [], []
            texts = batch.column("text").to_pylist()
            every = [words_of(text) for text in texts]
            for text, words, found in zip(texts, every, patterns.automata(every), strict=True):
                ranges, ks = scan(found, words) if found else ([], ())
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in ranges])
                names.append(sorted({ids[k] for k in ks}))
                if ranges:  # lower-casing A-Z moves nothing, so words lie where they did
                    at = [m.span() for m in word.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
                    spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
                else:
                    spans.append([])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(n_words, pa.int64()), pa.array(hits, span), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))],
                names=["doc_id", "digest", "n_words", "hits", "spans", "items"],
            )

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    kind = dict(rows.dtypes)["doc_id"]
    part = "array<struct<start int, end int>>"
    return map_batches(rows, make, f"doc_id {kind}, digest long, n_words long, hits {part}, spans {part}, items array<string>")


def blocks_of(benchmark: DataFrame, window: int, block_words: int, longest: int, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(item, text, block) stored and the number of blocks; texts over `longest` words come in overlapping parts."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    words = F.filter(F.split(text, " "), lambda w: w != "")
    step = longest - window + 1
    parts = (
        benchmark.filter(F.col(item_col).isNotNull())
        .select(F.col(item_col).cast("string").alias("item"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice("words", i + 1, longest), " "))).alias("text"))
        .distinct()
    )
    parts = stored(parts, shared_dir(benchmark.sparkSession), "items")
    words = parts.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    n = 1 if words <= block_words else -(-2 * words // block_words)
    return parts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", at_once: int = 60_000, block_words: int = 2_000_000, longest: int = 1_000) -> DataFrame:
    """doc_id, n_words, hits, spans, items for every document."""
    spark = docs.sparkSession
    parts, n = blocks_of(benchmark, window, block_words, longest, item_col, item_text)
    folder = shared_dir(spark)
    for k in range(n):
        sent = spark.sparkContext.broadcast(Patterns([tuple(r) for r in parts.filter(F.col("block") == k).select("item", "text").collect()], window, at_once))
        found = scanned(docs, sent, id_col, text_col)
        if n == 1:
            return found.drop("digest")
        # All rows of the first block, and of the others those with hits.
        found = found.withColumn("first", F.lit(k == 0))
        (found if k == 0 else found.filter(F.size("hits") > 0)).write.parquet(f"{folder}/block={k}")
        sent.destroy()
    every = spark.read.schema(found.schema).parquet(*[f"{folder}/block={k}" for k in range(n)])
    # Rows that repeat an id and a text have the same hits: one of them is kept for each block and counted.
    every = every.groupBy("doc_id", "digest", "first", "n_words", "hits", "spans", "items").agg(F.count(F.lit(1)).alias("n"))
    # A document's hits from each block are put together; n_rows: the rows that repeat it.
    merged = every.groupBy("doc_id", "digest").agg(
        F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).cast("int").alias("n_rows"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    again = merged.withColumns({c: united(c) for c in ("hits", "spans")}).withColumn("row", F.explode(F.sequence(F.lit(1), "n_rows")))
    return again.drop("n_rows", "row", "digest")


def united(column: str):
    """Overlapping or touching ranges as one."""
    empty = F.expr("cast(array() as array<struct<start int, end int>>)")

    def add(done, x):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(column), empty, add)


def digest(found: DataFrame) -> DataFrame:
    """The counts of `decontaminate`: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

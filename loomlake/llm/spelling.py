"""Spelling variants: words one edit apart, by a bit-sliced position index.

1. Words are counted: each task counts its own in a bounded table, Spark adds the counts.
2. Two words one edit apart share the first or the last (m - 1) // 2 letters, m the length of the shorter. So a word is filed under four keys, (side, m, letters) with m its
   length and its length less one, and every near pair meets under one of them.
3. The words of some keys make a block of at most BLOCK words. For each position and letter, a bit set has the block's words with that letter there. A
   word is looked up letter by letter, for all words of the block at once: four bit sets hold the words that agree so far without
   an error, with a replaced letter, with a letter more (read one position ahead) and with a letter less (one position behind).
4. A key with more words than BLOCK is dealt over blocks, and its words are looked up in each of them, streamed behind the block's own words.
5. A word's form is its near word of largest count, if that is RATIO times its own at least; roots are found by doubling the steps along forms, of which
   a chain has one for each factor RATIO in the counts.

Defined cases: null text has no words; a row without an id is named by an empty id; rows that repeat an id and a text all count; very long texts are read whole; of near words
that occur equally often the smallest in code-point order is the form; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, portable, shared_dir, spread_join, stored

portable(__name__)

#: Letters of a word at least, occurrences at least, and how much more frequent a form is.
LETTERS, LEAST, RATIO = 7, 2, 10
#: One run in so many loses a letter.
SLIPS = 31
#: Words of a block, and different words that a task counts before it hands them on.
BLOCK, HELD = 4096, 200_000
RUNS = rf"[A-Za-zÀ-ÿ]{{{LETTERS},}}"

COUNTS = "word string, n long"
FILED = "key string, block int, role int, word string, n long"
NEAR = "word string, n long, other string, other_n long"


def counted(batches):
    """name, text -> COUNTS; a word may come more than once."""
    runs, held = re.compile(RUNS), Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for name, text in zip(batch.column("name").to_pylist(), batch.column("text"), strict=True):
            # bytes.lower changes only A-Z
            words = Counter(runs.findall(memoryview(text.as_buffer()).tobytes().lower().decode()))
            start = zlib.crc32(f"{name}:".encode())
            for word, n in words.items():
                h = zlib.crc32(word.encode(), start)
                if h % SLIPS == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LETTERS:
                        continue
                held[word] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of LETTERS letters or more that occur LEAST times or more."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(counted, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


class PositionIndex:
    """For each position and letter, the words that have that letter there, as bits of an integer."""

    def __init__(self, words: list[str]):
        self.words = words
        longest = max(map(len, words))
        self.at: list[dict[str, int]] = [{} for _ in range(longest + 2)]
        self.sizes: dict[int, int] = {}
        for i, word in enumerate(words):
            bit = 1 << i
            self.sizes[len(word)] = self.sizes.get(len(word), 0) | bit
            for place, letter in zip(self.at, word, strict=False):
                place[letter] = place.get(letter, 0) | bit
        self.all = (1 << len(words)) - 1

    def near(self, word: str) -> list[int]:
        """Places of the words exactly one replaced, inserted or deleted letter away."""
        m, at = len(word), self.at
        if len(at) <= m:
            at = at + [{}] * (m + 2 - len(at))
        exact, replaced, more, less = self.all, 0, 0, 0
        before: dict[str, int] = {}
        for j, letter in enumerate(word):
            here, ahead = at[j].get(letter, 0), at[j + 1].get(letter, 0)
            # More: the index has a letter that `word` lacks, so `letter` stands one position ahead there. Less: one position behind.
            more = (more | exact) & ahead
            less = (less & before.get(letter, 0)) | exact
            same = exact & here
            replaced = (replaced & here) | (exact ^ same)
            exact, before = same, at[j]
            if not (exact or replaced or more or less):
                return []
        found = (replaced & self.sizes.get(m, 0)) | ((more | exact) & self.sizes.get(m + 1, 0)) | (less & self.sizes.get(m - 1, 0))
        out = []
        while found:
            low = found & -found
            out.append(low.bit_length() - 1)
            found ^= low
        return out


def looked_up(batches):
    """FILED rows, sorted by key, block and role (0: in the index, 1: only looked up in it) -> NEAR.

    Small keys share an index: pairs across keys are dropped, and so are pairs that meet under another key too.
    """
    keys, words, counts, index, open_block = [], [], [], None, None
    pairs = []

    def look(key, word, n):
        for i in index.near(word):
            if keys[i] == key and meets(key, word, words[i]):
                pairs.append((word, n, words[i], counts[i]))

    def close():
        nonlocal index
        if words and index is None:
            index = PositionIndex(words)
            for key, word, n in zip(keys, words, counts, strict=True):
                look(key, word, n)

    def out():
        done, pairs[:] = pairs[:], []
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "other", "other_n"])

    for batch in batches:
        for key, block, role, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "role", "word", "n")), strict=True):
            if role == 0:
                if index is not None or ((key, block) != open_block and len(words) >= BLOCK // 4):
                    close()
                    keys, words, counts, index = [], [], [], None
                open_block = (key, block)
                keys.append(key)
                words.append(word)
                counts.append(n)
            elif (key, block) == open_block:  # else no word fell into this block
                close()
                look(key, word, n)
            if len(pairs) >= 10_000:
                yield out()
    close()
    if pairs:
        yield out()


def meets(key: str, a: str, b: str) -> bool:
    """Whether a pair is due under this key: its m is the shorter length, and the first letters go before the last."""
    m = min(len(a), len(b))
    half = (m - 1) // 2
    return key.startswith(f"{key[0]}{m}:") and (key[0] == "a" or a[:half] != b[:half])


def filed(words: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """FILED: each word under its keys; a key with more than `block` words is dealt over blocks and looked up in all of them."""
    m = F.col("m")
    half = F.floor((m - 1) / 2).cast("int")
    sides = F.array(F.concat(F.lit("a"), m, F.lit(":"), F.substring("word", F.lit(1), half)), F.concat(F.lit("z"), m, F.lit(":"), F.expr("right(word, cast(floor((m - 1) / 2) as int))")))
    size = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size - 1))).filter(m >= LETTERS).select(F.explode(sides).alias("key"), "word", "n")
    keys = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), folder, "keys")
    rows = spread_join(rows, keys, "key", "many", ["word"])
    blocks = F.ceil(F.col("many") / block).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    own_row = rows.select("key", own.alias("block"), F.lit(0).alias("role"), "word", "n")
    others = rows.filter(F.col("many") > block).select("key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("role"), "word", "n")
    return own_row.unionByName(others.filter("block != own").drop("own"))


def near_pairs(words: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """NEAR: each ordered pair of near words once, with both counts."""
    return filed(words, folder, block).repartition("key", "block").sortWithinPartitions("key", "block", "role", "word").mapInArrow(looked_up, NEAR)


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    words = stored(vocabulary(docs, id_col, text_col), folder, "words")
    best = F.min(F.when(F.col("other_n") >= RATIO * F.col("n"), F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))))
    near = near_pairs(words, folder, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = stored(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")), folder, "near")
    # Each round follows twice as many forms.
    step, n = stored(near.filter("form is not null").select("word", F.col("form").alias("root")), folder, "root0"), 0
    while True:
        n += 1
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(step.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), folder, f"root{n}")
        step = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return (
        words.join(near, "word", "left")
        .join(step, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )

"""Katz backoff of any order, evaluated recursively from a stored table for each order.

Model of order k over words w after contexts h of k - 1 words, h' being h without its first word:

    P_k(w | h) = d_k(c(h w)) c(h w) / D(h)                where training has h w,
               = B(h) / (D(h) (1 - S(h))) P_(k-1)(w | h')  otherwise, for a context training has,
               = P_(k-1)(w | h')                          for a context never seen,

with discounts, D, B and P_1 as in `katz` (whose model is this one at order 2), and S(h) the sum of
P_(k-1)(w | h') over the words seen after h, so every context sums to 1 exactly. Before a text stand
k - 1 start marks.

Tables. A gram of k words is a 64-bit hash made from its first k - 1 words' hash and its last word, so one pass over
a block of texts gives each gram with its context and its suffix. `grams`, partitioned by order, has
each gram once with its count in training; grams that only held-out texts have stand there with count 0.
Order k is then evaluated for each distinct gram, not for each token: it joins its suffix's probability
of order k - 1 (the recursion), its context's sums are one aggregation, and the result is stored as the
table of order k. Last, each document's distinct grams of the highest order are joined with it; grams that many documents
have are dealt over tasks. A key of the other joins has at most as many rows as there are words, whatever the corpus holds.

Defined cases are those of `katz`: null text counts as empty, an empty text is the end token alone, a very long text
is a block of its own, repeated rows each count and get the same scores, rows without an id are taken by the
crc32 of the empty text, without training texts every token has probability 1, an empty table gives no rows, and other
columns are ignored, whatever their names. Ties don't occur: nothing is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portable, shared_dir, spread_join, stored
from .katz import K, PLACES, START, Vocabulary, blocks, by_count, discounts, training_rows

portable(__name__)

REMEMBERED = 200_000  # words that a task keeps numbers of


def mixed(context, word):
    """The hash of a gram: of its context's hash and its last word's code."""
    import numpy as np

    x = (np.asarray(context, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ np.asarray(word, np.uint64)
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(32)


def gram_ids(codes, begin, order: int) -> list:
    """For each order the grams that end at each place; texts begin at `begin`, with a start mark there."""
    import numpy as np

    word, mark = codes.view(np.uint64), np.array([START], np.uint64)
    ids = [word]
    for _ in range(1, order):
        own = mixed(np.concatenate([mark, ids[-1][:-1]]), word)
        mark = mixed(mark, [START])
        own[begin] = mark[0]
        ids.append(own)
    return ids


def read_blocks(batches, order: int):
    """(task's block number, block, token places, documents of places, training mask, ids by order) of each block."""
    import numpy as np
    from pyspark import TaskContext

    words, task = Vocabulary(), TaskContext.get().partitionId()
    for k, block in enumerate(blocks(batches)):
        every, begin = words.block(block.column("text").to_pylist())
        token = every != 0
        place = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[token]
        train = ~np.array(block.column("held_out").to_pylist(), bool)
        yield (task << 24 | k) << PLACES, block, token, place, train, gram_ids(words.codes()[every], begin[:-1], order)
        if len(words) > REMEMBERED:
            words.clear()


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """k, g (gram), h (context), s (suffix), c (count in training), m (documents that have it; of the highest order only)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, _, token, place, train, ids in read_blocks(batches, order):
            for k, own in enumerate(ids, 1):
                g, first, at = np.unique(own[token], return_index=True, return_inverse=True)
                c = np.bincount(at, train[place], len(g)).astype(np.int64)
                h = s = m = np.zeros(len(g), np.int64)
                if k > 1:
                    lower = ids[k - 2]
                    spot = np.flatnonzero(token)[first]  # never a text's first place
                    h, s = lower[spot - 1].view(np.int64), lower[spot].view(np.int64)
                if k == order:
                    m = np.bincount(np.unique(at.astype(np.int64) << PLACES | place) >> PLACES, minlength=len(g)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), *map(pa.array, (g.view(np.int64), h, s, c, m))], names=["k", *"ghscm"])

    found = rows.select("held_out", "text").mapInArrow(run, "k int, g long, h long, s long, c long, m long")
    return found.groupBy("k", "g").agg(F.min("h").alias("h"), F.min("s").alias("s"), F.sum("c").alias("c"), F.sum("m").alias("m"))


def asked(rows: DataFrame, order: int) -> DataFrame:
    """a (a document's number), g, n (times) of each document's distinct grams of the highest order.

    The gram with the end token, one of each document, carries its id, held_out and n_tokens.
    """
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for number, block, token, place, _, ids in read_blocks(batches, order):
            own, size = ids[-1][token], np.bincount(place, minlength=block.num_rows)
            by = np.lexsort((own, place))
            first = np.flatnonzero(np.r_[True, (np.diff(place[by]) != 0) | (own[by][1:] != own[by][:-1])])
            n = np.diff(np.append(first, len(by)))
            d = place[by][first]
            end = np.isin(np.arange(len(by)), np.cumsum(size) - 1)[by]  # the last token of each text
            named = np.logical_or.reduceat(end, first)
            doc = pa.array(d, mask=~named)
            columns = [pa.array(number + d), pa.array(own[by][first].view(np.int64)), pa.array(n), block.column("doc_id").take(doc), block.column("held_out").take(doc), pa.array(size).take(doc)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "g", "n", "doc_id", "held_out", "n_tokens"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"a long, g long, n long, doc_id {id_type}, held_out boolean, n_tokens long")


def order_discounts(grams: DataFrame) -> list[float]:
    counts = grams.filter(F.col("c").between(1, K + 1)).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return discounts({r["c"]: r["n"] for r in counts.collect()})  # K + 1 rows at most


def probabilities(grams: DataFrame, k: int, folder: str) -> DataFrame:
    """g, p (P_k), word_c (the last word's count), m for each gram of order k, stored."""
    own = grams.filter(F.col("k") == k).drop("k")
    d = order_discounts(own)
    kept = by_count(F.col("c"), d, 1.0) * F.col("c")
    if k == 1:
        n, mass = own.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(kept), F.lit(0.0))).first()
        whole = n if n - mass > 1e-9 * n else n + 1
        p: Column = F.when(F.col("c") > 0, kept / F.lit(float(whole))).otherwise(F.lit((whole - mass) / whole))
        return stored(own.select("g", p.alias("p"), F.col("c").alias("word_c"), "m"), folder, f"order_{k}")
    lower = probabilities(grams, k - 1, folder).select(F.col("g").alias("s"), F.col("p").alias("low"), "word_c")
    after = own.join(lower, "s").drop("s")
    seen = F.col("c") > 0
    contexts = (
        after.filter(seen)
        .groupBy("h")
        .agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") <= K, F.col("c") - kept).otherwise(0.0)).alias("b"), F.sum("low").alias("s"))
        .select("h", (F.col("n") + F.when(F.col("b") > 0, 0).otherwise(1)).alias("d"), F.when(F.col("b") > 0, F.col("b")).otherwise(F.lit(1.0)).alias("b"), "s")
    )
    p = F.when(seen, kept / F.col("d")).otherwise(F.col("low") * F.coalesce(F.col("b") / F.col("d") / (1 - F.col("s")), F.lit(1.0)))
    return stored(after.join(contexts, "h", "left").select("g", p.alias("p"), "word_c", "m"), folder, f"order_{k}")


def score(docs: DataFrame, order: int, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `katz.score` for every row of `docs`, by a model of `order` words."""
    if order < 1:
        raise ValueError("the order is 1 or more")
    folder = shared_dir(docs.sparkSession)
    rows = training_rows(docs, held, id_col, text_col)
    counts = gram_counts(rows, order)
    path = f"{folder}/grams"
    counts.write.partitionBy("k").parquet(path)
    grams = docs.sparkSession.read.schema(counts.schema).parquet(path)
    n, v = grams.filter("k = 1 and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    met = spread_join(asked(rows, order), probabilities(grams, order, folder), "g", "m", ["a"])
    times = lambda value: F.sum(F.col("n") * F.log10(value))
    found = met.groupBy("a").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")],
        F.sum(F.when(F.col("word_c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        times(F.col("word_c") + 1).alias("base"),
        times(F.col("p")).alias("score"),
    )
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"), "score"
    )

"""Language-model scoring: Katz backoff over word pairs, with Good-Turing discounts.

Model. Texts are lower-cased (A-Z), cut into words, and end with one end token; a start mark
stands before the first. With c counts of the training texts, N tokens and n_r types of count r,

    P(w | h) = d(c(h w)) c(h w) / D(h)            where the pair was seen in training,
             = B(h) / (D(h) (1 - S(h))) P(w)      otherwise, for a context h seen in training,
             = P(w)                               for a context never seen,
    P(w)     = d1(c(w)) c(w) / N'                 for known words, the rest for unknown ones.

d(r) for r up to 5 are Good-Turing discounts ((r*/r - A) / (1 - A), r* = (r+1) n_(r+1) / n_r,
A = 6 n_6 / n_1), or r / (r + 1) where the counts of counts give none between 0 and 1. B(h) is the sum of
(1 - d(r)) r over h's pairs, the mass that discounts left, and S(h) the sum of P over the words
seen after h, so every context sums to 1 exactly. A context whose pairs all have counts above 5 gets
B(h) = 1 and D(h) = c(h) + 1, else D(h) = c(h); likewise N' = N + 1 where no count is discounted.

Tables. Words are 64-bit hashes; the `hot` most frequent words (a fixed number, broadcast) have
16-bit codes instead. Counting and scoring pairs is one shuffle: a block of documents sends its
pairs, with the places of the documents they stand in, to parts, as runs of one context; a part
holds all of a context, but for hot words with more than a tenth of a part's tokens, whose pairs are spread by pair. Each part counts its
pairs and stores them, a row for each context (the table of pairs: h, its words, their counts),
and looks its documents' pairs up in them where it stands: it adds up log10 c of the pairs that training
has. A pair that training lacks goes one order lower: its context's weight and, for rare words, P(w) are
looked up in the table of single words (`words`: count, P, D, B, S), where the recursion ends. What
rests on hot words' counts alone is summed in the block. Pairs that many documents of a block hold are
counted once for the block and joined with their counts afterwards, so no part gets a row for each
document of the corpus. Sums over documents are ordinary aggregations.

Defined cases: null text counts as empty; an empty text is the end token alone; a very long text is
a block of its own, worked on whole; rows that repeat an id and a text each count in training and
get the same scores; rows without an id are taken by the crc32 of the empty text; ties in frequency
only decide which words have short codes, never a score; without training texts every token has the
unknown word's probability 1; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, portable, shared_dir, stored, text_of

portable(__name__)

K = 5  # counts above are not discounted
START, END = 1, 2
FIRST_HOT, LIMIT = 16, 1 << 20  # hot words have the codes from 16, all below LIMIT
PLACES = 10  # bits of a document's place in its block
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Vocabulary:
    """Numbers of words in the order of their first use (0: start mark, 1: end), and their codes."""

    def __init__(self, names=None, codes=None):
        """names, codes: sorted hashes of hot words and their codes."""
        self.names, self.hot = names, codes
        self.clear()

    def clear(self) -> None:
        import numpy as np

        class Numbers(dict):
            def __missing__(self, word):
                self[word] = found = len(self) + 2
                return found

        self.numbers, self.known = Numbers(), np.array([START, END], np.int64)

    def __len__(self) -> int:
        return len(self.numbers) + 2

    def block(self, texts: list):
        """The word numbers of all texts, each between 0 and 1, and where each text begins."""
        import numpy as np

        number, out = self.numbers.__getitem__, []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
            own = np.empty(len(words) + 2, np.int64)
            own[0], own[-1] = 0, 1
            own[1:-1] = np.fromiter(map(number, words), np.int64, len(words))
            out.append(own)
        return np.concatenate(out), np.append(0, np.cumsum([len(x) for x in out]))

    def codes(self):
        """The code of each number: those of hot words, else 64-bit hashes."""
        import itertools

        import numpy as np
        import xxhash

        fresh = itertools.islice(self.numbers, len(self.known) - 2, None)
        new = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(self) - len(self.known)).view(np.int64)
        new[(new >= 0) & (new < LIMIT)] += LIMIT
        if self.names is not None and len(self.names) and len(new):
            at = np.minimum(np.searchsorted(self.names, new), len(self.names) - 1)
            new = np.where(self.names[at] == new, self.hot[at], new)
        self.known = np.append(self.known, new)
        return self.known


def blocks(batches, docs: int = 1_000, size: int = 6 << 20):
    """Slices of Arrow batches: up to `docs` rows of about `size` bytes of text (one row at least)."""
    for batch in batches:
        at = used = 0
        lengths = [len(t) if t else 0 for t in batch.column("text").to_pylist()]
        for i, n in enumerate(lengths):
            if i > at and (used + n > size or i - at >= docs):
                yield batch.slice(at, i - at)
                at, used = i, 0
            used += n
        if at < batch.num_rows:
            yield batch.slice(at)


def word_counts(rows: DataFrame, remembered: int = 200_000) -> DataFrame:
    """w, c over training rows; the end token and the start mark (as often as rows) included."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, counts = Vocabulary(), np.zeros(2, np.int64)

        def table():
            return pa.RecordBatch.from_arrays([pa.array(words.codes()), pa.array(counts)], names=["w", "c"])

        for block in blocks(batches):
            every, _ = words.block(block.column("text").to_pylist())
            found = np.bincount(every, minlength=len(words))
            found[: len(counts)] += counts
            counts = found
            if len(words) > remembered:
                yield table()
                words.clear()
                counts = np.zeros(2, np.int64)
        yield table()

    return rows.filter(~F.col("held_out")).select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).filter("c > 0")


def pair_blocks(rows: DataFrame, hot, parts: int, common: int, remembered: int = 200_000) -> DataFrame:
    """Pairs of blocks of documents, as arrays, by part.

    A block has a number, to which a document's place is added. Three kinds of rows: `docs` names a
    block's documents with their sums over hot words; the pairs of one block in one part are h (contexts) with hn (entries
    of each), and for each entry w, d (place, -1: none) and n (times, negative in held-out
    documents); a pair that at least `common` documents of a block hold has one entry without
    place, whose n counts the training ones, and a row of its own, without hn, with places d and times n of each document.
    h and w have the codes of hot words, 0 for others, whose codes are in `h_far` and `far`, in the order of their entries.
    """
    id_type = dict(rows.dtypes)["doc_id"]
    doc_type = f"doc_id: {id_type}, held_out: boolean, n_tokens: long, known: long, x: double, y: double"
    schema = f"part int, block long, docs array<struct<{doc_type}>>, h array<short>, h_far array<long>, hn array<int>, w array<short>, far array<long>, d array<short>, n array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tables = hot.value
        words = Vocabulary(tables["names"], tables["codes"])
        count, is_spread = tables["count"], tables["spread"]
        log_more, log_c = np.log10(count + 1.0), np.log10(np.maximum(count, 1))
        task = TaskContext.get().partitionId()
        kinds = dict(h=pa.int16(), h_far=pa.int64(), hn=pa.int32(), w=pa.int16(), far=pa.int64(), d=pa.int16(), n=pa.int32())

        def lists(values, ends, kind):
            return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))

        def batch_of(part, number, docs, **columns):
            """columns: (values, ends of the rows' lists); h and w are split here, missing lists are empty."""
            for name, far in (("h", "h_far"), ("w", "far")):
                if name in columns:
                    values, ends = columns[name]
                    rare = (values < 0) | (values >= LIMIT)
                    columns[name] = np.where(rare, 0, values).astype(np.uint16).view(np.int16), ends
                    columns[far] = values[rare], np.append(0, np.cumsum(rare))[ends]
            none = np.zeros(0, np.int64), np.zeros(len(part), np.int64)
            made = [lists(*columns.get(k, none), kind) for k, kind in kinds.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), number, np.int64)), docs, *made], names=["part", "block", "docs", *kinds]
            )

        def no_docs(kind, size):
            return pa.ListArray.from_arrays(pa.array(np.zeros(size + 1, np.int32)), pa.array([], kind))

        def dealt(h, w, salt=0):
            """Parts: by context, pairs after the most frequent words by pair."""
            spread = np.where(is_spread[np.where((h >= 0) & (h < LIMIT), h, 0)], w, 0).view(np.uint64) ^ np.uint64(salt)
            mixed = (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ spread) * np.uint64(0xC2B2AE3D27D4EB4F)
            return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)

        for k, block in enumerate(blocks(batches)):
            number = (task << 24 | k) << PLACES
            train = ~np.array(block.column("held_out").to_pylist(), bool)
            every, begin = words.block(block.column("text").to_pylist())
            codes, begin, size = words.codes(), begin[:-1], np.diff(begin)

            own = codes[every]
            near = (own >= 0) & (own < LIMIT)
            own = np.where(near, own, 0)
            token = near & (every != 0)
            sums = [
                np.add.reduceat(token & (count[own] > 0), begin, dtype=np.int64),
                -np.add.reduceat(np.where(near & (every != 1), log_c[own], 0.0), begin),
                np.add.reduceat(np.where(token, log_more[own], 0.0), begin),
            ]
            docs = pa.StructArray.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(size - 1), *(pa.array(x) for x in sums)], names=["doc_id", "held_out", "n_tokens", "known", "x", "y"]
            )
            yield batch_of(np.array([(task + k) % parts]), number, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs))

            # One sort of (context, word, place) in a number each.
            place = np.repeat(np.arange(len(size)), size)
            key = (every[:-1] << (27 + PLACES) | every[1:] << PLACES | place[:-1])[every[:-1] != 1].view(np.uint64)
            key.sort()
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.diff(np.append(at, len(key)))
            key = key[at].view(np.int64)
            d = key & ((1 << PLACES) - 1)
            key >>= PLACES
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            holders = np.diff(np.append(first, len(key)))
            h, w = codes[key[first] >> 27], codes[key[first] & ((1 << 27) - 1)]
            wide = holders >= common
            every_wide = np.repeat(wide, holders)
            if wide.any():
                ends, one = np.cumsum(holders[wide]), np.arange(1, int(wide.sum()) + 1)
                yield batch_of(dealt(h[wide], w[wide], number & 0x7FFFFFFF), number, no_docs(docs.type, len(one)), h=(h[wide], one), w=(w[wide], one), d=(d[every_wide], ends), n=(n[every_wide], ends))
            n = np.where(train[d], n, -n)
            if wide.any():
                counts = np.add.reduceat(np.maximum(n[every_wide], 0), np.append(0, ends[:-1]))
                d[first[wide]], n[first[wide]] = -1, counts
                every_wide[first[wide]] = False
                d, n, holders = d[~every_wide], n[~every_wide], np.where(wide, 1, holders)
            pair = np.repeat(np.arange(len(first)), holders)
            part = dealt(h, w)[pair]
            order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
            part, pair, d, n = part[order], pair[order], d[order], n[order]
            context = (key[first] >> 27)[pair]
            fresh = np.r_[True, part[1:] != part[:-1]]
            runs = np.flatnonzero(fresh | np.r_[True, context[1:] != context[:-1]])
            begin = np.flatnonzero(fresh)
            ends, run_ends = np.append(begin[1:], len(part)), np.append(np.searchsorted(runs, begin[1:]), len(runs))
            yield batch_of(
                part[begin], number, no_docs(docs.type, len(begin)), h=(h[pair[runs]], run_ends), hn=(np.diff(np.append(runs, len(part))), run_ends), w=(w[pair], ends), d=(d, ends), n=(n, ends)
            )
            if len(words) > remembered:
                words.clear()
        pa.default_memory_pool().release_unused()  # this worker process lives on beside others

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)


CLASSES = [f"m{r}" for r in range(1, K + 2)]


def counted_schema(id_type: str) -> str:
    """Rows of `counter`, by kind.

    doc: a (a document's place), x (log10 of counts), y (log10 of rare words' counts + 1), c (known words), m1 .. m5 (pairs
        with these counts); the rows that blocks send have its id, held_out and n_tokens as well
    context: h, ws, far, n (the words after it and their counts), x (sum of P of the hot ones), m1 .. m6 (pairs with these counts)
    common: h, w, c of pairs that have wide rows;  wide: h, w, docs, n (times)
    back: h, docs, n: pairs after h that training lacks;  low: a, w, c (times): rare words in such pairs
    flat: h, docs, n: pairs after a hot word without a discounted pair in this part
    """
    return f"kind string, a long, doc_id {id_type}, held_out boolean, n_tokens long, h long, w long, c long, x double, y double, " + ", ".join(f"{m} int" for m in CLASSES) + ", ws array<short>, far array<long>, docs array<long>, n array<int>"


def counter(hot, id_type, pieces: int = 4):
    """A function that counts the pairs of one part. hot: broadcast tables of hot words by code."""

    def count_part(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = {"kind": pa.string(), "a": pa.int64(), "doc_id": id_type, "held_out": pa.bool_(), "n_tokens": pa.int64(), **dict.fromkeys("hwc", pa.int64()), "x": pa.float64(), "y": pa.float64()}
        kinds |= {**dict.fromkeys(CLASSES, pa.int32()), "ws": pa.list_(pa.int16()), "far": pa.list_(pa.int64()), "docs": pa.list_(pa.int64()), "n": pa.list_(pa.int32())}
        out = []

        def add(kind, size, **columns):
            if size:
                columns["kind"] = pa.array([kind], pa.string()).take(pa.array(np.zeros(size, np.int32)))
                columns = {k: x if isinstance(x, pa.Array) else pa.array(x, kinds[k]) for k, x in columns.items()}
                out.append(pa.table([columns[k] if k in columns else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds)))

        def flat(name, rows):
            return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

        def lists(values, starts, kind):
            return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype()), kind))

        def is_hot(codes):
            return (codes >= 0) & (codes < LIMIT)

        def words_of(rows, name="w", far="far"):
            w = flat(name, rows).view(np.uint16).astype(np.int64)
            w[w == 0] = flat(far, rows)
            return w

        def starts_of(x):
            return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)

        p, log_p = hot.value["p"], hot.value["log_p"]
        named, runs = (pc.greater(pc.list_value_length(table.column(k)), 0) for k in ("docs", "hn"))
        names, wide, entries = table.filter(named), table.filter(pc.invert(pc.or_(named, runs))), table.filter(runs)
        del table
        if names.num_rows:
            docs = names.column("docs").combine_chunks()
            sizes = np.diff(docs.offsets.to_numpy())
            own = docs.flatten()
            places = np.repeat(names.column("block").to_numpy(), sizes) + np.concatenate([np.arange(s) for s in sizes])
            add("doc", len(own), a=places, **{k: own.field(v) for k, v in dict(doc_id="doc_id", held_out="held_out", n_tokens="n_tokens", c="known", x="x", y="y").items()})
        if wide.num_rows:
            d = wide.column("d").combine_chunks()
            places = np.repeat(wide.column("block").to_numpy(), pc.list_value_length(d).to_numpy()) + flat("d", wide).astype(np.int64)
            add("wide", wide.num_rows, h=words_of(wide, "h", "h_far"), w=words_of(wide), docs=lists(places, np.append(0, np.cumsum(pc.list_value_length(d).to_numpy())[:-1]), pa.int64()), n=wide.column("n").combine_chunks())
        del names, wide
        if not entries.num_rows:
            return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in kinds.values()], names=list(kinds))

        contexts, rank = np.unique(words_of(entries, "h", "h_far"), return_inverse=True)
        rank = np.repeat(rank.astype(np.int32), flat("hn", entries))
        w_all, n_all, d = words_of(entries), flat("n", entries), flat("d", entries)
        whole_all = d < 0
        sizes = pc.list_value_length(entries.column("w")).to_numpy()
        block = entries.column("block").to_numpy()
        del entries
        # Numbers of the documents that occur here: by a table of all places where that is small, else by sorting.
        spots = np.zeros(len(d), np.int32)
        if len(block) << PLACES <= 4 * len(d) + (1 << 20):
            place = np.repeat(np.arange(len(block), dtype=np.int32) << PLACES, sizes) + d
            present = np.zeros(len(block) << PLACES, bool)
            present[place[~whole_all]] = True
            used = np.flatnonzero(present)
            spots[~whole_all] = (np.cumsum(present, dtype=np.int32) - 1)[place[~whole_all]]
            used = block[used >> PLACES] + (used & ((1 << PLACES) - 1))
        else:
            place = np.repeat(block, sizes) + d
            used, spots[~whole_all] = np.unique(place[~whole_all], return_inverse=True)
        del place, d
        x, y, known = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used), np.int64)
        classes = np.zeros((K, len(used)), np.int32)
        upto = np.cumsum(np.bincount(rank, minlength=len(contexts)))
        bounds = np.searchsorted(upto, np.arange(1, pieces) * upto[-1] / pieces)
        piece = np.searchsorted(bounds, rank).astype(np.int8)
        for k in range(pieces):  # contexts at a time, for less memory
            own = np.flatnonzero(piece == k)
            if not len(own):
                continue
            # One number for context and word; words of one context that share it (next to never) need both as keys.
            key = rank[own].astype(np.uint64) << np.uint64(40) | (w_all[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24))
            order = np.argsort(key)
            key, w = key[order], w_all[own[order]]
            if ((key[1:] == key[:-1]) & (w[1:] != w[:-1])).any():
                order = np.lexsort((w_all[own], rank[own]))
                w = w_all[own[order]]
                first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (np.diff(rank[own[order]]) != 0)])
            else:
                first = starts_of(key)
            own = own[order]
            r, n, whole, spot = rank[own], n_all[own], whole_all[own], spots[own]
            size = np.diff(np.append(first, len(own)))
            c = np.add.reduceat(np.maximum(n, 0).astype(np.int64), first)
            n = np.abs(n)
            had = c > 0
            tr, tw, tc = r[first][had], w[first][had], c[had]
            shared = had & np.logical_or.reduceat(whole, first)
            add("common", int(shared.sum()), h=contexts[r[first][shared]], w=w[first][shared], c=c[shared])
            begin = starts_of(tr)
            sure = np.zeros(len(contexts), bool)  # contexts with a discounted pair here
            if len(tr):
                hot_w = is_hot(tw)
                by = {m: np.add.reduceat((tc == i).astype(np.int32), begin) for i, m in enumerate(CLASSES, 1)}
                sure[tr[begin]] = sum(by[m] for m in CLASSES[:K]) > 0
                far_at = np.append(0, np.cumsum(~hot_w))[begin]
                add(
                    "context", len(begin), h=contexts[tr[begin]], x=np.add.reduceat(np.where(hot_w, p[np.where(hot_w, tw, 0)], 0.0), begin), **by,
                    ws=lists(np.where(hot_w, tw, 0).astype(np.uint16).view(np.int16), begin, pa.int16()), far=lists(tw[~hot_w], far_at, pa.int64()), n=lists(tc, begin, pa.int32()),
                )
            each = np.repeat(c, size)
            seen = (each > 0) & ~whole
            x += np.bincount(spot[seen], n[seen] * np.log10(each[seen]), len(used))
            for i in range(1, K + 1):
                one = seen & (each == i)
                classes[i - 1] += np.bincount(spot[one], n[one], len(used)).astype(np.int32)
            new = np.flatnonzero((each == 0) & ~whole)
            if len(new):
                hot_w = is_hot(w[new])
                x += np.bincount(spot[new[hot_w]], n[new[hot_w]] * log_p[w[new[hot_w]]], len(used))
                rare = new[~hot_w]
                add("low", len(rare), a=used[spot[rare]], w=w[rare], c=n[rare].astype(np.int64))
                begin_new = starts_of(r[new])
                add("back", len(begin_new), h=contexts[r[new[begin_new]]], docs=lists(used[spot[new]], begin_new, pa.int64()), n=lists(n[new], begin_new, pa.int32()))
            hot_h = is_hot(contexts)
            unsure = np.flatnonzero((hot_h & ~sure)[r] & ~whole)
            if len(unsure):
                begin_un = starts_of(r[unsure])
                add("flat", len(begin_un), h=contexts[r[unsure[begin_un]]], docs=lists(used[spot[unsure]], begin_un, pa.int64()), n=lists(n[unsure], begin_un, pa.int32()))
            # All of a rare context is here, so its count and whether it has discounted pairs are known.
            if len(tr):
                count = np.zeros(len(contexts), np.int64)
                count[tr[begin]] = np.add.reduceat(tc, begin)
                inside = np.flatnonzero((~hot_h & (count > 0))[r] & ~whole)
                at, times = r[inside], n[inside]
                x -= np.bincount(spot[inside], times * np.log10(count + ~sure)[at], len(used))
                y += np.bincount(spot[inside], times * np.log10(count + 1.0)[at], len(used))
                known += np.bincount(spot[inside], times, len(used)).astype(np.int64)
        add("doc", len(used), a=used, c=known, x=x, y=y, **{m: classes[i] for i, m in enumerate(CLASSES[:K])})
        pa.default_memory_pool().release_unused()  # this worker process lives on beside others
        return pa.concat_tables(out)

    return count_part


def discounts(n: dict[int, int]) -> list[float]:
    """d(1) .. d(K) of Good and Turing in Katz's form, from the counts of counts."""
    found = []
    for r in range(1, K + 1):
        d = 0.0
        if n.get(r) and n.get(1):
            a = (K + 1) * n.get(K + 1, 0) / n[1]
            if a != 1:
                d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - a) / (1 - a)
        found.append(d if 0 < d < 1 else r / (r + 1))
    return found


def by_count(count: Column, values: list[float], other: float) -> Column:
    chosen = F.lit(other)
    for r, v in enumerate(values, 1):
        chosen = F.when(count == r, F.lit(v)).otherwise(chosen)
    return chosen


def hot_code(column: str) -> Column:
    return F.col(column).between(0, LIMIT - 1)


def looked_up(rows: DataFrame, words: DataFrame, column: str, how: str = "left") -> DataFrame:
    """`rows` with the columns of `words` for a code: hot words broadcast (their number is fixed), others joined."""
    table = words.withColumnRenamed("code", column)
    hot = hot_code(column)
    return rows.filter(hot).join(F.broadcast(table.filter(hot)), column, how).unionByName(rows.filter(~hot).join(table.filter(~hot), column, how))


def frequent(counted: DataFrame, most: int, steps: int = 64) -> list:
    """The rows (w, c) of the most frequent words, at most `most`: those above a cut through a histogram of log2 c.

    The histogram has at most 64 * `steps` rows, and no more than `most` words are sent to the driver.
    """
    counted = counted.filter(~F.col("w").isin(START, END)).withColumn("bin", F.floor(F.log2("c") * steps))
    left, cut = most, None
    for bin_, n in sorted(map(tuple, counted.groupBy("bin").agg(F.count(F.lit(1))).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        cut = bin_
    return [] if cut is None else sorted(map(tuple, counted.filter(F.col("bin") >= cut).select("w", "c").collect()), key=lambda r: (-r[1], r[0]))


def training_rows(docs: DataFrame, held: Column | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out, text (null: empty); by default rows whose id's crc32 modulo 7 is 2 are kept from training."""
    return docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, 7) == 2 if held is None else held).alias("held_out"), text_of(text_col).alias("text"))


def score(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = 60_000, entries: int = 1_200_000, common: int = 48, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    held: which rows to keep from training (default: crc32 of the id modulo 7 is 2).
    entries: tokens of a part, which a task holds at a time.
    order: words of the longest grams; other orders than 2 are evaluated by `backoff`, which hot, entries and common don't concern.
    """
    if order != 2:
        from . import backoff

        return backoff.score(docs, order, held, id_col, text_col)
    if FIRST_HOT + hot > 65_535:
        raise ValueError("codes of hot words have 16 bits")
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    folder = shared_dir(spark)
    rows = training_rows(docs, held, id_col, text_col)

    counted = stored(word_counts(rows), folder, "counts")
    tokens = F.col("w") != START
    total = counted.agg(F.sum(F.when(tokens, F.col("c"))).alias("n"), F.count(F.when(tokens, 1)).alias("v"), F.sum(F.when(~tokens, F.col("c"))).alias("texts")).first()
    n_tokens, n_types = int(total["n"] or 0), int(total["v"])
    one = discounts({r["c"]: r["n"] for r in counted.filter(tokens & (F.col("c") <= K + 1)).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()})
    kept = counted.filter(tokens).agg(F.sum(by_count(F.col("c"), one, 1.0) * F.col("c"))).first()[0] or 0.0
    whole = n_tokens if n_tokens - kept > 1e-9 * n_tokens else n_tokens + 1
    unknown = (whole - kept) / whole
    log_unknown = math.log10(unknown) if unknown > 0 else 0.0

    # Tables of hot words by code: at most `hot` words and the two marks.
    top = frequent(counted, hot)
    names = np.array([w for w, _ in top], np.int64)
    count = np.zeros(FIRST_HOT + len(top), np.int64)
    count[FIRST_HOT:] = [c for _, c in top]
    count[START], count[END] = int(total["texts"] or 0), int(counted.filter(F.col("w") == END).agg(F.sum("c")).first()[0] or 0)
    p = np.where(count <= K, np.array([0.0, *one])[np.minimum(count, K)], 1.0) * count / whole
    p[START] = 0.0
    log_p = np.where(p > 0, np.log10(np.where(p > 0, p, 1.0)), log_unknown)
    order = np.argsort(names)
    shared = spark.sparkContext.broadcast(dict(names=names[order], codes=order.astype(np.int64) + FIRST_HOT, count=count, p=p, log_p=log_p, spread=count > entries // 10))

    codes = spark.createDataFrame([(int(w), k) for k, (w, _) in enumerate(top, FIRST_HOT)], "w long, code long")
    p_word = F.when(F.col("code") == START, F.lit(0.0)).otherwise(by_count(F.col("c"), one, 1.0) * F.col("c") / F.lit(float(whole)))
    singles = counted.join(F.broadcast(codes), "w", "left").select(F.coalesce("code", "w").alias("code"), "c").withColumn("p", p_word)

    id_field = rows.schema["doc_id"].dataType
    parts = max(24, -(-n_tokens // entries))
    counting = counter(shared, to_arrow_type(id_field))
    pairs = by_kind(pair_blocks(rows, shared, parts, common).groupBy("part").applyInArrow(counting, counted_schema(id_field.simpleString())), folder, "pairs")
    contexts = pairs.filter("kind = 'context'")
    met = contexts.agg(*[F.sum(m).alias(m) for m in CLASSES]).first()
    two = discounts({r: met[m] or 0 for r, m in enumerate(CLASSES, 1)})

    # The table of single words: count, P, and as contexts log10 of D and of B / (1 - S).
    rare_p = singles.filter(~hot_code("code")).select("code", "p")
    rare_after = contexts.filter(F.size("far") > 0).select("h", F.explode("far").alias("code")).join(rare_p, "code").groupBy("h").agg(F.sum("p").alias("s"))
    left = sum((F.col(m) * F.lit(r * (1 - d)) for r, (m, d) in enumerate(zip(CLASSES, two, strict=False), 1)), F.lit(0.0))
    after = contexts.select("h", F.col("x").alias("s"), left.alias("b")).unionByName(rare_after, allowMissingColumns=True).groupBy(F.col("h").alias("code")).agg(F.sum("b").alias("b"), F.sum("s").alias("s"))
    words = singles.join(after, "code", "left").select(
        "code",
        "c",
        F.when(F.col("code") != START, F.log10("p")).alias("log_p"),
        F.log10(F.col("c") + F.when(F.coalesce("b", F.lit(0.0)) > 0, 0).otherwise(1)).alias("log_d"),
        (F.log10(F.when(F.col("b") > 0, F.col("b")).otherwise(F.lit(1.0))) - F.log10(1 - F.col("s"))).alias("log_a"),
    )
    words = stored(words, folder, "words")

    log_two = by_count(F.col("c"), [math.log10(d) for d in two], 0.0)
    none = F.lit(0.0)
    seen = pairs.filter("kind = 'doc'").select(
        "a", "doc_id", "held_out", "n_tokens", (F.col("x") + sum((F.coalesce(m, F.lit(0)) * F.lit(math.log10(d)) for m, d in zip(CLASSES, two, strict=False)), none)).alias("score"), F.col("y").alias("base"), F.col("c").alias("n_known")
    )

    def spread(df, value):
        """A row for each document of `docs`, with its times the value."""
        return df.withColumn("e", F.explode(F.arrays_zip("docs", "n"))).select(F.col("e.docs").alias("a"), (F.col("e.n") * value).alias("score"))

    backed = spread(looked_up(pairs.filter("kind = 'back'").select("h", "docs", "n"), words.select("code", "log_a"), "h", "inner"), F.col("log_a"))
    low = pairs.filter("kind = 'low'").select("a", F.col("w").alias("code"), F.col("c").alias("n")).join(words.filter(~hot_code("code")).select("code", "log_p"), "code", "left")
    low = low.select("a", (F.col("n") * F.coalesce("log_p", F.lit(log_unknown))).alias("score"))
    # Hot contexts were taken with D = c; those without a discounted pair anywhere have D = c + 1.
    flat_words = words.filter(hot_code("code") & (F.col("log_d") > F.log10("c"))).select(F.col("code").alias("h"), (F.log10("c") - F.col("log_d")).alias("more"))
    flat = spread(pairs.filter("kind = 'flat'").select("h", "docs", "n").join(F.broadcast(flat_words), "h"), F.col("more"))
    # Pairs that many documents of a block share: a row for each block, joined with its count.
    wide = pairs.filter("kind = 'wide'").select("h", "w", "docs", "n").join(pairs.filter("kind = 'common'").select("h", "w", "c"), ["h", "w"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    wide = looked_up(looked_up(wide, words.select("code", "log_a", "log_d", F.col("c").alias("h_c")), "h"), words.select("code", "log_p"), "w")
    log_pair = F.when(F.col("c") > 0, F.log10("c") + log_two).otherwise(F.coalesce("log_a", none) + F.coalesce("log_p", F.lit(log_unknown)))
    rare_h = ~hot_code("h") & (F.col("h_c") > 0)
    taken = F.when(F.col("h_c") > 0, F.when(hot_code("h"), F.col("log_d") - F.log10("h_c")).otherwise(F.col("log_d"))).otherwise(0.0)
    shared_pairs = wide.select(
        (log_pair - taken).alias("x"), F.when(rare_h, F.log10(F.col("h_c") + 1.0)).otherwise(0.0).alias("y"), rare_h.cast("long").alias("k"), F.explode(F.arrays_zip("docs", "n")).alias("e"),
    ).select(F.col("e.docs").alias("a"), (F.col("e.n") * F.col("x")).alias("score"), (F.col("e.n") * F.col("y")).alias("base"), (F.col("e.n") * F.coalesce("k", F.lit(0))).alias("n_known"))

    every = seen
    for more in (shared_pairs, backed, low, flat):
        every = every.unionByName(more, allowMissingColumns=True)
    found = every.groupBy("a").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], *[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(n_tokens + n_types + 1))).alias("base_score"),
        "score",
    )


def by_kind(df: DataFrame, folder: str, name: str) -> DataFrame:
    """`df` stored in a folder for each kind, written side by side so that rows need no sorting."""
    spark, key = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        df.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

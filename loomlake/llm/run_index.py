"""Removal of repeated byte strings by a run-length index (a run-compressed Burrows-Wheeler transform with sampled run ends).

Every byte that is covered by a string of WINDOW bytes that also starts anywhere else goes, in the same text or in another.

1. Each text's window starts are cut into segments: maximal runs of starts whose windows have the same smallest hash of GRAMS[0] bytes.
   Equal windows have equal hashes, wherever they lie, so all occurrences of a window meet under one key, and a start lies in one segment.
2. Keys whose hash occurs once in all texts hold nothing that repeats and are dropped; of equal segments one is kept, with their number.
3. The segments of whole keys make blocks of about BLOCK bytes. A block's suffixes are sorted, its transform is cut into runs, and the
   suffix is sampled at both ends of each run together with what it shares with its neighbour across the border. Matching statistics are
   streamed from these samples: from one byte to the next a match loses its first byte, unless a sample says more. Starts whose longest
   match elsewhere has WINDOW bytes are marked; a segment that stands for several is marked whole.
4. A key with more than LIMIT bytes of different segments (a short passage that very many texts share in different surroundings) isn't put in one block: its
   segments are cut again by smallest hashes of more bytes (GRAMS), in the end by whole windows, of which a key has one.
5. Marks go back to segments and texts by joins whose hot keys are dealt over tasks; each text then drops the marked bytes.

Texts cross the network twice at most, when pieces are taken out of them and when marked bytes are dropped; a bit filter of
bounded size holds back most texts that neither needs. All other tables have a short row for each segment.

Defined cases: null text counts as empty; texts of fewer bytes than WINDOW keep all bytes; very long texts are cut whole, a million starts at a time; exact copies go whole, all
of them, as do rows that repeat an id and a text; rows without an id are judged like others; an empty table gives no rows; other
columns are ignored, whatever their names. Spans and bytes are those of UTF-8; what is left need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filtered, map_batches, portable, shared_dir, spread_join, stored

portable(__name__)

WINDOW = 400
#: Bytes that are hashed to find a window's key: a key that holds too much is cut again by the next.
GRAMS = (64, 192, 320, WINDOW)
#: Window starts that are hashed at a time, and that a segment has at most.
STARTS, LONGEST = 1 << 20, 4096
#: Bytes of a block, and of different segments of one key that may lie in one block.
BLOCK, LIMIT = 1 << 19, 1 << 20
#: Symbols that are packed into the first sorting key, 9 bits each.
PACKED = 7

SEGMENTS = "row binary, start long, windows int, key long, times int, sid binary"
PIECES = "pid binary, key long, copies long, weight long, body binary"
FOUND = "pid binary, marks array<int>, copies long, body binary"


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Cutter:
    """Cuts bytes into segments of window starts with one smallest hash."""

    def __init__(self, gram: int, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.up = self.down = np.empty(0, np.uint64)

    def smallest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window start of `part`, the smallest hash of `gram` bytes inside the window, and whether the hash there is the smallest."""
        n, gram = len(part), self.gram
        if n > len(self.up):
            self.up, self.down = powers(n, BASE), powers(n, INVERSE)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width = self.window - gram + 1
        # Smallest of `width` neighbours: from both ends of blocks of `width`.
        blocks = np.concatenate([h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(back[: len(h) - width + 1], ahead[width - 1 : len(h)])
        return low, h[: len(low)] == low

    def cut(self, body: np.ndarray):
        """Arrays of starts, numbers of starts, keys and how often the hash occurs (2: twice or more), a million starts at a time."""
        for at in range(0, len(body) - self.window + 1, STARTS):
            low, here = self.smallest(body[at : at + STARTS + self.window - 1])
            new = np.concatenate([[True], low[1:] != low[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(low)))
            # A segment that goes on behind the place of its smallest hash has it again: its own windows may be equal.
            times = 1 + np.logical_or.reduceat(here & ~np.append(new[1:], True), first)
            parts = -(-size // LONGEST)
            if len(first) < parts.sum():
                nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                first, size, times = np.repeat(first, parts) + nth * LONGEST, np.minimum(np.repeat(size, parts) - nth * LONGEST, LONGEST), np.repeat(times, parts)
            yield first + at, size, low[first].view(np.int64), times


def name_of(body) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def cut_rows(window: int, gram: int):
    """row, body -> SEGMENTS"""

    def make():
        cutter = Cutter(gram, window)

        def step(batch):
            rows = batch.column("row")
            for i, body in enumerate(batch.column("body")):
                view = body.as_buffer()
                if view is None or len(view) < window:
                    continue
                memory = memoryview(view)
                for start, size, key, times in cutter.cut(np.frombuffer(view, np.uint8)):
                    names = [name_of(memory[a : a + n + window - 1]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(np.full(len(start), i))), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(key), pa.array(times, pa.int32()), binaries(names)],
                        names=["row", "start", "windows", "key", "times", "sid"],
                    )

        return step

    return make


def taken_out(window: int):
    """body, wanted -> PIECES"""

    def make():
        def step(batch):
            out = []
            for body, wanted in zip(batch.column("body"), batch.column("wanted").to_pylist(), strict=True):
                memory = memoryview(body.as_buffer())
                out += [(w["sid"], w["key"], w["copies"], w["weight"], memory[w["start"] : w["start"] + w["windows"] + window - 1].tobytes()) for w in wanted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["pid", "key", "copies", "weight", "body"])

        return step

    return make


def cut_again(window: int, gram: int):
    """pid, copies, body -> parent, off, pid, key, copies, body"""

    def make():
        cutter = Cutter(gram, window)

        def step(batch):
            for parent, copies, body in zip(batch.column("pid"), batch.column("copies").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for start, size, key, _ in cutter.cut(np.frombuffer(body, np.uint8)):
                    parts = [body[a : a + n + window - 1] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [binaries([parent.as_py()] * n), pa.array(start, pa.int32()), binaries([name_of(x) for x in parts]), pa.array(key), pa.array([copies] * n, pa.int64()), binaries(parts)],
                        names=["parent", "off", "pid", "key", "copies", "body"],
                    )

        return step

    return make


class RunIndex:
    """Run-compressed transform of some pieces with the suffixes at run ends and what they share across the border.

    Each piece ends with a separator that equals nothing, so no match crosses pieces.
    """

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.ends = np.cumsum(self.size + 1) - 1
        self.symbols = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
        self.symbols[self.ends] = 0
        order = self.suffixes()
        before = self.symbols[order - 1]
        # A separator equals no other, so a piece's first suffix is a run of its own.
        border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
        self.runs = len(border) + 1
        self.tails, self.heads = order[border - 1], order[border]
        self.shared = self.common(self.tails, self.heads)

    def suffixes(self) -> np.ndarray:
        """All suffixes in order, by doubling the bytes that are ranked; only those still tied are sorted again."""
        n, m = len(self.symbols), len(self.ends)
        padded = np.concatenate([self.symbols, np.zeros(PACKED, np.uint16)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(PACKED):
            key = (key << np.uint64(9)) | padded[j : j + n]
        order = np.argsort(key)
        key = key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
        # Separators come first, each of them different.
        order[:m], rank[self.ends], head[:m] = self.ends, np.arange(m), True
        if n > m:
            head[m] = True
        depth = PACKED
        while True:
            size = np.diff(np.append(np.flatnonzero(head), n))
            place = np.flatnonzero(np.repeat(size > 1, size))
            if not len(place):
                return order
            at = order[place]
            pair = (rank[at] << 32) | rank[np.minimum(at + depth, n - 1)]
            by = np.argsort(pair)
            pair, at = pair[by], at[by]
            order[place] = at
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            head[place] = new
            rank[at] = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
            depth *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at `a` and `b` share, eight at a time."""
        n = len(self.symbols)
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.symbols.astype(np.uint8), np.zeros(8, np.uint8)]), 8)[:n]
        words = np.ascontiguousarray(eight).view("<u8").ravel()
        end = np.repeat(self.ends, self.size + 1)
        room = np.minimum(end[a] - a, end[b] - b)
        out = room.copy()
        live, done = np.flatnonzero(room > 0), 0
        while len(live):
            differ = words[a[live] + done] ^ words[b[live] + done]
            unlike = np.flatnonzero(differ)
            if len(unlike):
                lowest = differ[unlike] & (~differ[unlike] + np.uint64(1))
                byte = np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
                out[live[unlike]] = np.minimum(done + byte, room[live[unlike]])
            done += 8
            live = live[(differ == 0) & (room[live] > done)]
        return out

    def statistics(self) -> np.ndarray:
        """For each byte of the pieces, the longest match of what starts there with what starts at another byte."""
        n = len(self.symbols)
        reach = np.zeros(n, np.int64)
        reach[self.heads] = self.shared + self.heads
        reach[self.tails] = np.maximum(reach[self.tails], self.shared + self.tails)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def marked(pieces: list[bytes], copies: list[int], window: int) -> list[list[int]]:
    """For each piece the marked spans, as start, end, start, end, ..."""
    index = RunIndex(pieces)
    hot = index.statistics() >= window
    first = index.ends - index.size
    for i, n in enumerate(copies):
        if n > 1:
            hot[first[i] : index.ends[i] - window + 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hot, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2] + window - 1
    owner = np.searchsorted(index.ends, start)
    spans = np.stack([start - first[owner], end - first[owner]], axis=1)
    border = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [spans[border[i] : border[i + 1]].ravel().tolist() for i in range(len(pieces))]


def searched(window: int, limit: int | None):
    """PIECES, those of a key together -> FOUND; pieces of keys over `limit` are passed on with their bytes."""

    def run(batches):
        names, copies, bodies, size, last_key, last_name = [], [], [], 0, None, None

        def out(pids, marks, counts, rest):
            return pa.RecordBatch.from_arrays([binaries(pids), pa.array(marks, pa.list_(pa.int32())), pa.array(counts, pa.int64()), binaries(rest)], names=["pid", "marks", "copies", "body"])

        for batch in batches:
            ready, passed = [], []
            for pid, key, n, weight, body in zip(*(batch.column(c).to_pylist() for c in ("pid", "key", "copies", "weight", "body")), strict=True):
                if limit and weight > limit:
                    passed.append((pid, None, n, body))
                    continue
                if key != last_key and size >= BLOCK:
                    ready += [(p, m, c, None) for p, m, c in zip(names, marked(bodies, copies, window), copies, strict=True) if m]
                    names, copies, bodies, size = [], [], [], 0
                if (key, pid) != (last_key, last_name):
                    names.append(pid)
                    copies.append(n)
                    bodies.append(body)
                    size += len(body)
                last_key, last_name = key, pid
            if ready or passed:
                yield out(*zip(*(ready + passed), strict=True))
        if names:
            ready = [(p, m, c, None) for p, m, c in zip(names, marked(bodies, copies, window), copies, strict=True) if m]
            if ready:
                yield out(*zip(*ready, strict=True))

    return run


def search(pieces: DataFrame, window: int, limit: int | None) -> DataFrame:
    """Blocks of whole keys; a key over the limit is dealt over tasks, since its pieces are only passed on."""
    salt = F.lit(0) if limit is None else F.when(F.col("weight") > limit, F.pmod(F.xxhash64("pid"), F.floor(F.col("weight") / limit))).otherwise(0)
    return pieces.repartition(F.col("key"), salt).sortWithinPartitions("key", "pid").mapInArrow(searched(window, limit), FOUND)


def row_of(id_col: str, body: Column) -> Column:
    """A digest of id and text: rows that share it have the same text."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(name.cast("binary"), F.lit("\0").cast("binary"), body)))


def weighed(pieces: DataFrame, size: Column) -> DataFrame:
    """`pieces` with all bytes of their key's different pieces as `weight`."""
    keys = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum(size).cast("long").alias("weight"))
    return spread_join(pieces, keys, "key", "many", ["pid"]).drop("many")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grams: tuple[int, ...] = GRAMS, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): id, row and body of each row of `docs`, and for each row with repeated bytes its marked spans, not yet merged."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_of(id_col, body).alias("row"), body.alias("body"))
    segments = stored(map_batches(rows.select("row", "body"), cut_rows(window, grams[0]), SEGMENTS), folder, "segments")
    keys = stored(segments.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("times").alias("times")).filter("times > 1").drop("times"), folder, "keys")
    kept = stored(spread_join(segments.drop("times"), keys, "key", "many", ["row", "start"]).drop("many"), folder, "kept")

    # A piece for each different segment, taken from one of the rows that have it.
    pieces = stored(
        kept.groupBy(F.col("sid").alias("pid")).agg(F.min("key").alias("key"), F.min("windows").alias("windows"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start")).alias("at")),
        folder,
        "pieces",
    )
    wanted = (
        weighed(pieces, F.col("windows") + (window - 1))
        .groupBy(F.col("at.row").alias("row"))
        .agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "windows", "key", F.col("pid").alias("sid"), "copies", "weight")).alias("wanted"))
    )
    wanted = stored(wanted, folder, "wanted")
    bodies = bit_filtered(rows.select("row", "body"), wanted, "row").join(wanted, "row").select("body", "wanted")
    found = [stored(search(map_batches(bodies, taken_out(window), PIECES), window, limit), folder, "found0")]
    inner = []
    for level, gram in enumerate(grams[1:], 1):
        rest = found[-1].filter("body is not null").select("pid", "copies", "body")
        if rest.isEmpty():
            break
        parts = stored(map_batches(rest, cut_again(window, gram), "parent binary, off int, pid binary, key long, copies long, body binary"), folder, f"parts{level}")
        inner.append(parts.select("parent", "off", "pid"))
        one = parts.groupBy("pid").agg(F.min("key").alias("key"), F.sum("copies").alias("copies"), F.min("body").alias("body"))
        one = stored(one, folder, f"one{level}")
        last = level == len(grams) - 1
        found.append(stored(search(weighed(one, F.octet_length("body")).select("pid", "key", "copies", "weight", "body"), window, None if last else limit), folder, f"found{level}"))

    # Marks of inner pieces become marks of the pieces they were cut from, from the innermost out.
    marks = None
    for level in range(len(found) - 1, -1, -1):
        own = found[level].filter("marks is not null").select("pid", "marks")
        if marks is not None:
            count = inner[level].groupBy("pid").agg(F.count(F.lit(1)).alias("many"))
            table = stored(marks.join(count, "pid"), folder, f"marks{level}")
            moved = spread_join(inner[level], table, "pid", "many", ["parent", "off"]).select(F.col("parent").alias("pid"), F.expr("transform(marks, x -> x + off)").alias("marks"))
            own = own.unionByName(moved.groupBy("pid").agg(F.flatten(F.collect_list("marks")).alias("marks")))
        marks = own
    table = stored(marks.join(pieces.select("pid", "copies"), "pid").withColumnRenamed("pid", "sid"), folder, "marks")
    spans = (
        spread_join(kept.select("row", "start", "sid"), table, "sid", "copies", ["row", "start"])
        .select("row", F.expr("transform(marks, x -> x + start)").alias("marks"))
        .groupBy("row")
        .agg(F.flatten(F.collect_list("marks")).alias("marks"))
    )
    return rows, stored(spans, folder, "spans")


def merged(marks: np.ndarray) -> np.ndarray:
    """Maximal spans of overlapping or touching ones, in order."""
    spans = marks.reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > far[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], far[np.append(first[1:], len(spans)) - 1]], axis=1)


def without_marked(make_body: bool):
    """doc_id, body, marks -> doc_id, n_bytes, n_removed, spans, kept_sha256 (and kept)"""

    def make():
        def step(batch):
            spans, digests, kept, sizes, removed = [], [], [], [], []
            for body, marks in zip(batch.column("body"), batch.column("marks"), strict=True):
                memory = memoryview(body.as_buffer())
                found = merged(marks.values.to_numpy(zero_copy_only=False)).tolist()
                digest, parts, at = hashlib.sha256(), [], 0
                for a, b in [*found, (len(memory), len(memory))]:
                    digest.update(memory[at:a])
                    if make_body:
                        parts.append(memory[at:a])
                    at = b
                spans.append([x for span in found for x in span])
                digests.append(digest.hexdigest())
                kept.append(b"".join(parts))
                sizes.append(len(memory))
                removed.append(sum(b - a for a, b in found))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(digests)]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            if make_body:
                columns.append(binaries(kept))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return make


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grams: tuple[int, ...] = GRAMS, limit: int = LIMIT, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end, start, end, ... of removed runs) and kept_sha256 of every row; with `with_bytes` also the bytes that are left, as `kept`."""
    rows, spans = repeated_spans(docs, id_col, text_col, window, grams, limit)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, spans array<long>, kept_sha256 string" + (", kept binary" if with_bytes else "")
    # Rows that the filter holds back, or that it lets through without marks, keep all their bytes; their texts aren't moved for the first.
    maybe = bit_filtered(rows, spans, "row", flag="maybe")
    hit = maybe.filter("maybe").join(spans, "row").select("doc_id", "body", "marks")
    whole = ["doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<long>").alias("spans"), F.sha2("body", 256).alias("kept_sha256")]
    whole += [F.col("body").alias("kept")] if with_bytes else []
    clean = maybe.filter("not maybe").select(*whole)
    passed = maybe.filter("maybe").select("row", *whole).join(spans.select("row"), "row", "left_anti").drop("row")
    return map_batches(hit, without_marked(with_bytes), schema).unionByName(clean).unionByName(passed)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `drop_repeats`."""
    return found.select("doc_id", "n_bytes", "n_removed", F.expr("cast(size(spans) / 2 as long)").alias("n_spans"), "kept_sha256")

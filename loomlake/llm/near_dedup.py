"""Near duplicates: banded MinHash, odd sketches, links confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct runs of five words; two documents are
linked when 100 * intersection >= 75 * union. Steps:

1. Signatures, where the documents lie: the set's size and digest, `bands` x `rows` MinHash
   values folded into one key for each band, and the odd sketch of all values: a bitmap in which each
   (place, value) flips one bit, so the XOR of two bitmaps counts the values that differ.
2. Documents with equal sets become one node (by a digest of 128 bits and the size), so copies cost nothing more.
3. Nodes that share a band key are candidates. With 64 bands of 6, a pair at the threshold is
   missed with probability 4e-6, a pair at 0.8 with 4e-9.
4. Rounds: each key takes one node as pivot, in an order that changes from round to round, and
   the others may be compared with it, so a key with n nodes costs n comparisons, not n * n. Of a
   node's pivots the `tries` that share most of its keys are. Odd sketches drop pairs whose estimate lies more than 4.5 standard errors below the threshold; the others
   (in the first round the best of each node) are confirmed on the full sets, and linked groups are merged. Rounds go on while
   they pay (at most `rounds`): one in which fewer than 1 in PAYS likely pairs are links is the last, so a large group of near copies is
   one group before step 5, and nodes near a group but not in it aren't tested against ever more of its members.
   Only the full sets of a round's pairs move, a pair that has failed isn't tested again in a later round, and keys whose members lie in one group take part no longer.
5. What is left: pairs that share a key but lie in different groups. Members without a likely partner under
   their key, by sketches, go first, so that most sets move nowhere. The others are all compared inside
   the join, by sketches and then by shortened hashes, which lose no link and let next to nothing else pass; those pairs are
   confirmed on the full sets, and groups are merged. After that no
   candidate pair is untested except inside one group, where it could change nothing.

Groups are merged by pointer jumping, after the first round along minimum labels of neighbours. Nothing is collected on the driver but
counts. Tables between steps lie in the shared folder, small ones in few files, and a step's shuffle files go when it ends.

Defined cases: a very long text has all its shingles in its set; of equal ids the group shows one; null, empty and blank texts have no shingles and are linked with nothing; a text of
fewer than five words has one shingle; rows that repeat an id each get a row; a group's id is its
smallest non-null doc_id (null if all are null, and then no row of it is kept, but for rows without
shingles, which keep their own id); an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filtered, map_batches, portable, shared_dir, shuffles_released, spread_join, stored, text_of

portable(__name__)

BITS = 1024
WORDS64 = BITS // 64
SLICE = 200  # documents worked on at a time
PAYS = 50  # likely pairs of a round for each link that it must find, or step 5 takes the rest
SHORT = 4096  # sets up to this size are told apart by 16 bits of each hash, larger ones by 32
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Shingler:
    """Distinct shingle hashes of texts; remembers the hashes of up to `remembered` words."""

    def __init__(self, width: int, remembered: int = 100_000):
        import numpy as np
        import xxhash

        class Known(dict):
            def __missing__(self, word):
                if len(self) > remembered:
                    self.clear()
                self[word] = found = xxhash.xxh64_intdigest(word)
                return found

        self.np, self.width, self.known = np, width, Known()

    def __call__(self, text: str | None):
        """Sorted uint64 hashes."""
        np, width = self.np, self.width
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        ids = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        if not len(ids):
            return ids
        used = min(width, len(ids))
        found = np.full(len(ids) - used + 1, used, np.uint64)
        for k in range(used):
            found = (found ^ ids[k : len(ids) - used + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(31)
        return np.unique(found)


class Signer:
    """Band keys and odd sketch of a set of hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        import numpy as np

        made = np.random.default_rng(seed)
        k = bands * rows
        self.np, self.bands, self.rows = np, bands, rows
        self.factors = made.integers(0, 1 << 32, k, np.uint64).astype(np.uint32) | np.uint32(1)
        self.places = made.integers(0, 1 << 62, k, np.int64).astype(np.uint64)
        self.first = made.integers(0, 1 << 62, bands, np.int64).astype(np.uint64)

    def __call__(self, hashes):
        np = self.np
        mixed = ((hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for low in range(0, len(mixed), 128):  # small enough for the cache
            np.minimum(least, (mixed[low : low + 128, None] * self.factors).min(axis=0), out=least)
        values = least.astype(np.uint64)
        keys = self.first.copy()
        for column in values.reshape(self.bands, self.rows).T:
            keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
        spots = (values ^ self.places) * np.uint64(0xC2B2AE3D27D4EB4F)
        spots = (spots ^ spots >> np.uint64(33)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - int(math.log2(BITS)))
        flipped = np.bincount(spots.astype(np.int64), minlength=BITS).astype(np.uint8) & 1
        return keys.view(np.int64), np.packbits(flipped).view(np.int64)


def most_bits(hashes: int, threshold: float, errors: float) -> int:
    """The largest XOR population count of a pair that may reach the threshold."""
    apart = 2 * hashes * (1 - threshold)
    fades = math.exp(-2 * apart / BITS)
    expected = BITS / 2 * (1 - fades)
    spread = math.sqrt(4 * hashes * threshold * (1 - threshold) * fades**2 + BITS / 4 * (1 - fades**2))
    return math.ceil(expected + errors * spread)


def signatures(docs: DataFrame, bands: int, rows: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc (key of the row's content), n_shingles, node and check (digests of the set), keys, sketch of each document."""

    def make():
        import numpy as np
        import pyarrow as pa
        import xxhash

        shingle, sign = Shingler(width), Signer(bands, rows)

        def step(whole):
            for low in range(0, whole.num_rows, SLICE):
                yield signed(whole.slice(low, SLICE))

        def signed(batch):
            n, node, check, keys, sketch = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle(text)
                n.append(len(found))
                if len(found):
                    a, b = sign(found)
                    high, low = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist()
                    node.append(high)
                    check.append(low)
                    keys.append(a)
                    sketch.append(b)
                else:
                    node.append(None)
                    check.append(None)
                    keys.append(())
                    sketch.append(())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("doc"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                names=["doc_id", "doc", "n_shingles", "node", "check", "keys", "sketch"],
            )

        return step

    rows_ = keyed(docs, id_col, text_col)
    return map_batches(rows_, make, f"doc_id {dict(rows_.dtypes)['doc_id']}, doc long, n_shingles long, node long, check long, keys array<long>, sketch array<long>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("doc"), text_of(text_col).alias("text"))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str, most: int = 1_000_000) -> DataFrame:
    """node, shingles for the documents named in `wanted` (doc, node)."""
    rows = keyed(docs, id_col, text_col).select("doc", "text")
    if wanted.count() <= most:  # a checked size: 16 bytes each
        wanted = F.broadcast(wanted)

    def make():
        import pyarrow as pa

        shingle = Shingler(width)

        def step(whole):
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                found = [shingle(t).view("int64") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

        return step

    # A document's key may stand for repeated rows: one of them is enough.
    return map_batches(rows.join(wanted, "doc").select("node", "text"), make, "node long, shingles array<long>")


def bits_apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, WORDS64)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def sized(a: str, b: str, threshold: int) -> Column:
    """Sizes that allow the threshold (in hundredths)."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def linked_sets(threshold: int) -> Column:
    """100 * intersection >= threshold * union, with the union as the sizes less the intersection."""
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return (100 + threshold) * shared >= threshold * (F.size("a_set") + F.size("b_set"))


def shortened(sets: DataFrame, threshold: int) -> DataFrame:
    """node, short and wide: the distinct leading 16 and 32 bits of a set's hashes, null where no pair that may be linked compares them."""
    size = F.size("shingles")
    cut = lambda bits, kind: F.array_distinct(F.transform("shingles", lambda x: F.shiftright(x, 64 - bits).cast(kind)))
    return sets.select("node", F.when(size <= SHORT, cut(16, "short")).alias("short"), F.when(100 * size > threshold * SHORT, cut(32, "int")).alias("wide"))


def maybe_linked(threshold: int) -> Column:
    """Whether sets of a_n and b_n hashes can be linked as their shortened hashes stand: the intersection is at most theirs and what one of the two lost."""

    def most(kind: str) -> Column:
        a, b = f"a_{kind}", f"b_{kind}"
        return F.array_size(F.array_intersect(a, b)) + F.least(F.col("a_n") - F.array_size(a), F.col("b_n") - F.array_size(b))

    return (100 + threshold) * F.coalesce(most("short"), most("wide")) >= threshold * (F.col("a_n") + F.col("b_n"))


def told_apart(nodes: DataFrame, plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables by `node` alone: nodes that share it but not `check` (next to never) get a new one."""
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", F.lit(True).alias("shared"))
    if not shared.isEmpty():
        renamed = F.when(F.col("shared"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        nodes, plain = (df.join(shared, "node", "left").withColumn("node", renamed).drop("shared") for df in (nodes, plain))
    return nodes.drop("check"), plain.drop("check")


class Links:
    """Candidate tests and confirmation over the stored tables of one run."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, threshold: int, most: int):
        self.nodes, self.sets, self.threshold, self.most = nodes, sets, threshold, most

    def side(self, name: str) -> DataFrame:
        """The nodes' sizes and sketches under names for one side of a pair."""
        return self.nodes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"{name}_n"), *[F.col("sketch")[k].alias(f"{name}_s{k}") for k in range(WORDS64)])

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs a, b (and other columns) whose sketches may reach the threshold, with their distance."""
        both = pairs.join(self.side("a"), "a").join(self.side("b"), "b")
        return both.filter(sized("a_n", "b_n", self.threshold)).withColumn("apart", bits_apart("a_s", "b_s")).filter(F.col("apart") <= self.most).select(*pairs.columns, "apart")

    def sets_for(self, wanted: DataFrame, few: int = 200_000) -> DataFrame:
        """The sets of the nodes that the stored table `wanted` names, perhaps with some of others, told before any of them moves."""
        if wanted.count() <= few:  # 8 bytes each
            return self.sets.join(F.broadcast(wanted.distinct()), "node", "left_semi")
        return bit_filtered(self.sets, wanted, "node")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored pairs a, b whose full sets reach the threshold."""
        sets = self.sets_for(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
        first = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
        both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b")
        return both.filter(linked_sets(self.threshold)).select("a", "b")


def merged(groups: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """`groups` (node, comp) after merging along the stored `links` (a, b): each comp becomes its smallest one."""
    most = 2 * links.count()
    of = groups.select(F.col("node"), F.col("comp"))
    edges = (
        links.join(of.select(F.col("node").alias("a"), F.col("comp").alias("u")), "a")
        .join(of.select(F.col("node").alias("b"), F.col("comp").alias("v")), "b")
        .filter("u <> v")
        .select("u", "v")
    )
    edges = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), folder, f"{name}-edges", most)
    labels = stored(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), folder, f"{name}-labels-0", most)
    step = 0
    while True:
        step += 1
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        least = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "other").alias("mid"))
        jump = labels.select(F.col("u").alias("mid"), F.col("label").alias("far"))
        new = stored(least.join(jump, "mid", "left").select("u", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), folder, f"{name}-labels-{step}", most)
        if new.filter("label <> old").isEmpty():
            break
        labels = new.drop("old")
    return stored(
        groups.join(new.select(F.col("u").alias("comp"), "label"), "comp", "left").select("node", F.coalesce("label", "comp").alias("comp")), folder, f"{name}-groups", groups.count()
    )


def rooted(groups: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """`groups` after merging along the stored `links` in which each a points to one b and no path comes back: roots by pointer jumping."""
    parents, step, most = links, 0, links.count()
    while True:
        step += 1
        above = parents.select(F.col("a").alias("b"), F.col("b").alias("top"))
        new = stored(parents.join(above, "b", "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().alias("moved")), folder, f"{name}-roots-{step}", most)
        if new.filter("moved").isEmpty():
            break
        parents = new.drop("moved")
    return stored(groups.join(new.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "comp").alias("comp")), folder, f"{name}-groups", groups.count())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, width: int = 5, bands: int = 64, rows: int = 6, rounds: int = 16, tries: int = 3, errors: float = 4.5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`. threshold: in hundredths."""
    with shuffles_released(docs.sparkSession):
        return grouped(docs, id_col, text_col, threshold, width, bands, rows, rounds, tries, errors)


def grouped(docs: DataFrame, id_col: str, text_col: str, threshold: int, width: int, bands: int, rows: int, rounds: int, tries: int, errors: float) -> DataFrame:
    folder = shared_dir(docs.sparkSession)
    signed = stored(signatures(docs, bands, rows, width, id_col, text_col), folder, "signatures")
    plain = signed.select("doc_id", "doc", "n_shingles", "node", "check")
    nodes = stored(
        signed.filter("node is not null").groupBy("node", "check").agg(
            *[F.min_by(c, "doc").alias(c) for c in ("n_shingles", "keys", "sketch")], F.min("doc").alias("doc"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
        ),
        folder,
        "nodes",
    )
    nodes, plain = told_apart(nodes, plain)
    members = nodes.select("node", F.explode("keys").alias("key"))
    # Most keys are of one node: a bit filter keeps them from moving again.
    shared = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), folder, "shared")
    members = stored(bit_filtered(members, shared, "key", bits=26).join(shared, "key"), folder, "members")
    groups = stored(members.select("node").distinct().withColumn("comp", F.col("node")), folder, "groups")
    sets = stored(sets_of(docs, nodes.join(groups, "node", "left_semi").select("doc", "node"), width, id_col, text_col).dropDuplicates(["node"]), folder, "sets")
    signed_nodes = stored(nodes.join(groups, "node", "left_semi").select("node", "n_shingles", "sketch"), folder, "sketches")
    links = Links(signed_nodes, sets, threshold, most_bits(bands * rows, threshold / 100, errors))

    n_members, n_nodes, tried = members.count(), groups.count(), None
    for k in range(rounds):
        placed = stored(members.join(groups, "node"), folder, f"placed-{k}", n_members)
        turn = F.xxhash64("node", F.lit(k))
        pivots = (
            placed.groupBy("key")
            .agg(F.min_by("node", turn).alias("b"), F.min_by("comp", turn).alias("b_comp"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            .filter("low <> high")
            .select("key", "b", "b_comp")
        )
        pivots = stored(pivots, folder, f"pivots-{k}", n_members // 2)
        members = placed.join(pivots, "key", "left_semi").select("key", "node")
        # A node has as many keys as bands; the pivots that it shares most of them with are the likeliest.
        met = placed.join(pivots, "key").filter("comp <> b_comp").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
        if tried is not None:  # what was linked lies in one group, and what failed would fail again
            met = met.join(tried, ["a", "b"], "left_anti")
        first = met.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "b"))), 1, tries).alias("b"))
        pairs = first.select("a", F.explode("b.b").alias("b"))
        if k == 0:
            likely = links.likely(pairs).groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
        else:
            pairs = stored(pairs, folder, f"tried-{k}", tries * n_nodes, each=20_000)
            likely = links.likely(pairs)
        likely = stored(likely.select("a", "b"), folder, f"likely-{k}", tries * n_nodes, each=20_000)
        n_likely = likely.count()
        found = stored(links.confirmed(likely), folder, f"round-{k}", n_likely, each=1_000)
        n_found = found.count()
        if not n_found:
            break
        done = pairs if k else likely
        done = done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = done if tried is None else tried.unionByName(done)
        # In the first round a node points to one that comes before it in the round's order, so links are trees.
        groups = (merged if k else rooted)(groups, found, folder, f"round-{k}")
        if PAYS * n_found < n_likely:
            break

    # Pairs of different groups under one key: members outside a key's largest group, against all others.
    placed = members.join(groups, "node")
    largest = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
    open_ = stored(placed.join(largest.filter("comps > 1").select("key", "main"), "key"), folder, "open")
    one = open_.filter("comp <> main").select("key", F.col("node").alias("a"), F.col("comp").alias("a_comp"))
    other = open_.select("key", F.col("node").alias("b"), F.col("comp").alias("b_comp"), (F.col("comp") == F.col("main")).alias("in_main"))
    near = (F.col("in_main") | (F.col("a") < F.col("b"))) & sized("a_n", "b_n", threshold) & (bits_apart("a_s", "b_s") <= links.most)

    def met(one: DataFrame, other: DataFrame, how: str, confirm: Column | None = None) -> DataFrame:
        # A merge join, as its hot keys are split over tasks.
        apart = (one["key"] == other["key"]) & (F.col("a_comp") != F.col("b_comp")) & near
        return one.join(other.hint("merge"), apart if confirm is None else apart & confirm, how)

    sketched_one, sketched_other = one.join(links.side("a"), "a"), other.join(links.side("b"), "b")
    one = stored(met(sketched_one, sketched_other, "left_semi"), folder, "rest-one")
    other = stored(met(sketched_other, one, "left_semi"), folder, "rest-other")
    named = stored(one.select(F.col("a").alias("node")).unionByName(other.select(F.col("b").alias("node"))).distinct(), folder, "rest-nodes", n_nodes)
    cut = stored(shortened(links.sets_for(named), threshold), folder, "rest-sets", named.count(), each=10_000)
    one = one.join(cut.select(F.col("node").alias("a"), F.col("short").alias("a_short"), F.col("wide").alias("a_wide")), "a")
    other = other.join(cut.select(F.col("node").alias("b"), F.col("short").alias("b_short"), F.col("wide").alias("b_wide")), "b")
    likely = stored(met(one, other, "inner", maybe_linked(threshold)).select("a", "b").distinct(), folder, "rest-likely")
    found = stored(links.confirmed(likely), folder, "rest", likely.count(), each=1_000)
    if not found.isEmpty():
        groups = merged(groups, found, folder, "rest-groups")

    # Back to the rows: components of nodes first, then rows of nodes; large ones are dealt over tasks.
    placed = nodes.select("node", "first_id", "copies").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stored(placed, folder, "placed")
    named = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_node = spread_join(placed.select("node", "copies", "comp"), stored(named, folder, "named"), "comp", "members", ["node"])
    of_node = stored(of_node.select("node", "copies", "component_id"), folder, "components")
    linked = spread_join(plain.filter("node is not null"), of_node, "node", "copies", ["doc"]).select("doc_id", "n_shingles", "component_id")
    alone = plain.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

"""The training-data operators against plain Python, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from loomlake.llm import common, decontamination, exact_dedup, katz, near_dedup, packing, quality, secrets, sharding, token_counts, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
KEY = "AKIA" + "Q7ZP" * 4
# Extra columns carry the names of results and of inner columns.
SCHEMA = "doc_id long, text string, kept boolean, shard int, id string, content string, score double, part int, n_words long"


def awkward(spark):
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    rows = base + [
        (1000, None), (1001, ""), (1002, " \t\n"), (1003, base[3][1]), (1004, base[3][1].replace(" ", "  ")), (1005, long), (1006, long + " end"),
        (1007, f"my Token: 'abcDEF0123456789zz' and {KEY} deadbeefdeadbeef00 é {'Zx9' * 3}Qw7+/aB3kLmN0pRsTuVwY"),
        (1008, "token: secret: ABCDEFGHIJKLMNOP"), (5, base[5][1]), (None, "no id here at all"), (None, None), (1009, "one two"), (1010, "One two"),
    ]
    return rows, spark.createDataFrame([(*r, None, 1, "x", None, 0.5, None, 7) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_secrets(spark):
    rows, docs = awkward(spark)
    noise = lambda seed, n: "".join(random.Random(seed).choices(secrets.CLASSES[1].alphabet, k=n))
    around = [  # allow-list matches inside, at both ends, next to each other, and nothing but matches
        noise(1, 150) + "Example" + noise(2, 150), "sample" + noise(3, 60) + "placeholder", noise(4, 30) + "EXAMPLEKEY", "0123456789" * 500,
        noise(5, 80) + "changeme" + noise(6, 3) + "abcdefgh" + noise(7, 47) + "xxxxxxxxxxxxxxxxx" + noise(8, 48), noise(9, 48) + "example" + noise(10, 47) + " é " + noise(11, 3000) + "sample",
    ]
    more = [(2000 + k, f"a {t} b") for k, t in enumerate(around)]
    rows, docs = rows + more, docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in secrets.digest(secrets.find_secrets(docs)).collect()), key=str)
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]

    def entropy(window):
        return sum(round(n * math.log2(n) * secrets.UNIT) for n in Counter(window).values())

    want = []
    for doc_id, text in rows:
        text = text or ""
        base = sorted((m.start(), no, f"{k}:{m.start()}:{m.end()}") for no, (k, rx, g, least) in enumerate(kinds) for m in rx.finditer(text) if len(m.group(g)) >= least)
        added = []
        for no, c in enumerate(secrets.CLASSES, 3):
            for m in re.finditer(c.pattern, text):
                hits = [x.span() for x in re.finditer(secrets.ALLOW, m.group())]
                free = lambda i: all(i >= b + c.window or i + c.window <= a - c.window for a, b in hits)  # noqa: B023, E731
                hot = [i for i in range(len(m.group()) - c.window + 1) if free(i) and entropy(m.group()[i : i + c.window]) <= c.limit]
                runs = []
                for i in hot:
                    if runs and i <= runs[-1][1]:
                        runs[-1][1] = i + c.window
                    else:
                        runs.append([i, i + c.window])
                added += [(m.start() + a, no, f"{c.name}:{m.start() + a}:{m.start() + b}") for a, b in runs]
        n = [sum(x[1] == k for x in base) for k in range(3)]
        digest = hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest()
        want.append((doc_id, *n, digest, ",".join(x[2] for x in sorted(base + added))))
    assert got == sorted(want, key=str)
    assert sum(r[1] for r in want) >= 1 and any("entropy" in r[5] for r in want)
    assert [r[5].count("entropy_base64") for r in sorted(want, key=lambda r: str(r[0])) if (r[0] or 0) >= 2000] == [2, 0, 0, 0, 2, 2]
    assert secrets.digest(secrets.find_secrets(empty(spark))).count() == 0


@pytest.mark.parametrize("at_once,block_words", [(60_000, 2_000_000), (100, 2_000_000), (100, 400)])
def test_decontamination(spark, at_once, block_words):
    """One automaton for all patterns, one for those whose keys a batch has, and the same block by block."""
    rows, docs = awkward(spark)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "One, TWO"), (901, None), (902, "..."), (None, "the"), (900, "One, TWO"), (903, "no id here")]
    items.append((904, " ".join(f"w{i % 997}x{i % 13}" for i in range(500, 3000))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.digest(decontamination.decontaminate(docs, bench, at_once=at_once, block_words=block_words, longest=50)).collect()
    word = re.compile(decontamination.WORD)
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    want = []
    for doc_id, t in rows:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r[5] for r in want) > 3


def test_decontamination_of_a_million_words(spark):
    """Documents are read once: nothing is written but the list of items."""
    import random

    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(5000)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([3, 9, 10, 300])))) for k in range(11_000)]
    assert sum(len(t.split()) for _, t in items) > 800_000
    docs = []
    for k in range(60):
        words = [word() for _ in range(200)]
        if k % 3 == 0:
            taken = items[rnd.randrange(len(items))][1].split()
            at = rnd.randrange(max(1, len(taken) - 30))
            words[50:50] = taken[at : at + 30]
        docs.append((k, " ".join(words)))
    windows = defaultdict(set)
    for i, t in items:
        w = t.split()
        for k in range(max(1, len(w) - 9)):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    want = []
    for i, t in docs:
        w, hit, found = t.split(), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((i, len(hit), tuple(sorted(found))))
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], sum(h["end"] - h["start"] for h in r["hits"]), tuple(r["items"])) for r in got) == want
    assert sum(x[1] > 0 for x in want) >= 15


def test_decontamination_spans_and_empty(spark):
    docs = spark.createDataFrame([(1, "É before; ONE -- two é")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two")], "item_id long, text string")
    row = decontamination.decontaminate(docs, bench).first()
    assert [tuple(s) for s in row["spans"]] == [(10, 20)] and [tuple(s) for s in row["hits"]] == [(2, 4)]
    assert decontamination.decontaminate(empty(spark), bench).count() == 0
    none = decontamination.digest(decontamination.decontaminate(docs, bench.limit(0))).first()
    assert (none["n_hit"], none["n_items"], none["contaminated"]) == (0, 0, False)


def encoded_length(path, text, known={}):  # noqa: B006
    """How many tokens byte pair merging leaves: the adjacent pair of the lowest rank first."""
    import base64

    import regex

    if not known:
        known["ranks"] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    ranks, n = known["ranks"], 0
    for piece in regex.findall(token_counts.PIECES, text):
        if piece not in known:
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            known[piece] = len(parts)
        n += known[piece]
    return n


def test_token_counts(spark):
    rows, docs = awkward(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lengths = [r[0] for r in token_counts.lengths(docs, path).collect()]
    assert sorted(lengths) == sorted(encoded_length(path, t or "") for _, t in rows)
    table = token_counts.suffix_table(token_counts.lengths(docs, path), span=64).cache()
    total = sum(lengths)
    for r in table.collect():
        limit = r["n_tokens"]
        kept = sum(min(x, limit) for x in lengths)
        assert (r["n_docs"], r["docs_longer"], r["docs_at_least"]) == (lengths.count(limit), sum(x > limit for x in lengths), sum(x >= limit for x in lengths))
        assert (r["kept_tokens"], r["lost_tokens"], r["total_tokens"]) == (kept, total - kept, total)
        assert math.isclose(r["fits"], sum(x <= limit for x in lengths) / len(lengths))
    limits = [1, 10, 333, 10**6]
    for r in token_counts.at_limits(table, limits).collect():
        assert r["kept_tokens"] == sum(min(x, r["context_limit"]) for x in lengths)
        assert r["docs_longer"] == sum(x > r["context_limit"] for x in lengths)
    for r in token_counts.quantiles(table, [0.5, 1.0]).collect():
        assert r["n_tokens"] == sorted(lengths)[math.ceil(r["share"] * len(lengths)) - 1]
    assert token_counts.suffix_table(token_counts.lengths(empty(spark), path)).count() == 0


def test_long_white_space(spark):
    """Runs that the piece pattern can't take in one go, alone, on both ends of words and between them, of blanks and mixed line ends."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    runs = [" " * 2_000_000, " \n" * 1_000_000, "\r\n\t" * 400_000 + "\u3000" * 1500, "\x1c" * 5000]
    texts = [t for r in runs for t in (r, "word" + r, r + "word", "a" + r + "'s 5" + r + "-")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r[0] for r in token_counts.lengths(docs, path).collect())
    count = token_counts.counter(path)
    assert got == sorted(map(count, texts))
    # Short runs take the same way with a small RUN as the whole text does without any.
    short = [t.replace(r, r[:k]) for r in runs for k in (2, 3, 40, 41) for t in (r, "word" + r, r + "word", "a" + r + "'s 5" + r + "-")]
    apart = short_counter(path, 2)
    for text in short:
        assert apart(text) == encoded_length(path, text) == count(text)
    # White space only, a byte a token unless the vocabulary merges it: what whole pieces give.
    assert count(" " * 2_000_000) == 2_000_000


def short_counter(path, run):
    old, token_counts.RUN = token_counts.RUN, run
    try:
        return token_counts.counter(path)
    finally:
        token_counts.RUN = old


@pytest.mark.parametrize("entries,common", [(5_000, 4), (600, 1_000)])
def test_katz(spark, entries, common):
    rows, docs = awkward(spark)
    got = katz.score(docs, hot=200, entries=entries, common=common).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two, context = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            s = ["<s>", *tokens(t), "</s>"]
            one.update(s[1:])
            two.update(zip(s, s[1:], strict=False))
            context.update(s[:-1])
    n, v = sum(one.values()), len(one)
    d1, d2 = (katz.discounts(dict(Counter(c.values()))) for c in (one, two))
    cut = lambda d, c: d[c - 1] if c <= katz.K else 1.0
    kept = sum(cut(d1, c) * c for c in one.values())
    whole = n if n - kept > 1e-9 * n else n + 1
    single = lambda w: cut(d1, one[w]) * one[w] / whole if w in one else (whole - kept) / whole
    mass, seen = defaultdict(float), defaultdict(float)
    for (h, w), c in two.items():
        mass[h] += (1 - cut(d2, c)) * c
        seen[h] += single(w)

    def p(h, w):
        if h not in context:
            return single(w)
        whole_h, b = (context[h], mass[h]) if mass[h] > 0 else (context[h] + 1, 1.0)
        c = two.get((h, w), 0)
        return cut(d2, c) * c / whole_h if c else b / whole_h / (1 - seen[h]) * single(w)

    for h in list(context)[:20]:  # every context sums to one
        assert math.isclose(sum(p(h, w) for w in one) + p(h, "\0unknown"), 1.0, rel_tol=1e-9)
    want = []
    for i, t in rows:
        s = ["<s>", *tokens(t), "</s>"]
        pairs = list(zip(s, s[1:], strict=False))
        want.append((i, held(i), len(s) - 1, sum(one[w] > 0 for w in s[1:]), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in s[1:]), sum(math.log10(p(*x)) for x in pairs)))
    for a, b in zip(sorted(map(tuple, got), key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)
    assert katz.score(empty(spark)).count() == 0


def test_sharding(spark):
    rows, docs = awkward(spark)
    got = sharding.shard(docs, shards=7).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())].append(t or "")
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted((k for k, ts in texts.items() for _ in ts), key=str)
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(x) == 1 for x in homes.values())
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert sharding.shard(empty(spark)).count() == 0


@pytest.mark.parametrize("sizes,shards", [([5, 1, 1, 9, 2, 2, 3], 3), ([1] * 10, 4), ([7], 3), ([], 2), ([0, 0, 4, 0], 2)])
def test_cuts_are_minimax(sizes, shards):
    def best(k, n):
        if n == 1:
            return sum(sizes[k:])
        return min(max(sum(sizes[k:j]), best(j, n - 1)) for j in range(k, len(sizes) + 1))

    capacity, place = sharding.cuts_for(sizes, shards)
    loads = Counter()
    for s, x in zip(place, sizes, strict=True):
        loads[int(s)] += x
    assert list(place) == sorted(place) and (not sizes or max(loads.values()) == best(0, shards) == capacity)
    assert not loads or max(loads) < shards


def test_packing(spark):
    from tokenizers import Tokenizer

    rows, docs = awkward(spark)
    rows.append((2000, "ﬁ é 漢字 🙂 İ <|endoftext|> ½ it's"))
    docs = docs.unionByName(spark.createDataFrame([rows[-1]], "doc_id long, text string"), allowMissingColumns=True)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, longest=256, with_ids=True).collect()
    t = Tokenizer.from_file(path)
    want, found = Counter(), Counter()
    for i, text in rows:
        want[i, tuple(t.encode(text or "", add_special_tokens=False).ids) + (1,)] += 1
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    whole = defaultdict(list)
    for r in got:
        n = r["length"]
        assert n & (n - 1) == 0 and n <= 256 and len(r["ids"]) == n
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"]
        whole[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for (i, n), parts in whole.items():
        times = sum(s == 0 for s, _ in parts)
        ids = {}
        for s, x in parts:
            ids[s] = x
        text = tuple(x for s in sorted(ids) for x in ids[s])
        assert len(text) == n
        found[i, text] += times
    assert found == want
    for n in {r["length"] for r in got}:
        numbers = sorted(r["sequence_id"] for r in got if r["length"] == n)
        assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    assert packing.pack(empty(spark), path).count() == 0


def components(rows):
    sets, parent = [], {}
    for i, t in rows:
        w = lower(t).encode().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None and s:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, s) in enumerate(sets):
        c = least.get(find(k)) if s else i
        out.append((i, len(s), c, c is not None and i == c))
    return out


def test_near_dedup(spark):
    rows, docs = awkward(spark)
    words = [f"q{k}" for k in range(60)]
    for k in range(25):  # a chain whose ends are far apart, and variants of one text
        rows.append((3000 + k, " ".join([f"q{j}" for j in range(2 * k, 2 * k + 60)])))
        rows.append((3100 + k, " ".join(words[:k] + [f"z{k}"] + words[k:])))
    docs = docs.unionByName(spark.createDataFrame(rows[-50:], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((tuple(r) for r in near_dedup.near_dedup(docs).collect()), key=str)
    assert got == sorted(components(rows), key=str)
    assert near_dedup.near_dedup(empty(spark)).count() == 0


def test_odd_sketch_estimates():
    import numpy as np

    sign, made = near_dedup.Signer(64, 6), np.random.default_rng(3)
    for share in (0.75, 0.9):
        both = int(400 * share)
        x = made.integers(0, 1 << 63, 800 - both, np.int64).astype(np.uint64)
        (_, a), (_, b) = sign(x[:400]), sign(x[400 - both :])
        apart = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64))
        guess = 1 + 1024 / (4 * 384) * math.log(1 - 2 * apart / 1024)
        assert abs(guess - both / (800 - both)) < 0.1


def test_exact_dedup(spark):
    rows, docs = awkward(spark)
    got = exact_dedup.exact_dedup(docs).collect()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[t]), keep is None or i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("module,label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers(spark, module, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = module(docs, labels).cache()
    assert scored.count() == 1000 and scored.filter("score < 0 or score > 1").count() == 0
    checked = [tuple(r) for r in scored.filter("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()]
    assert sum(p == y for p, y, _ in checked) / len(checked) > (0.95 if label == "quality" else 0.9)
    rows, odd = awkward(spark)
    assert module(odd, labels).count() == len(rows)  # null, empty and long texts, repeated rows
    assert module(empty(spark), labels).count() == 0
    alone = module(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in alone] == [0.5 if label == "quality" else 0.0]


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    from loomlake.llm.labelled import held_out

    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(map(tuple, quality.score_quality(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_spread_join(spark):
    rows = spark.createDataFrame([(k % 3 if k < 90 else 7, k) for k in range(100)], "key int, id int")
    table = rows.groupBy("key").count()
    want = sorted((k % 3 if k < 90 else 7, k, 30 if k < 90 else 10) for k in range(100))
    for few in (0, 1_000):
        got = common.spread_join(rows, table, "key", "count", ["id"], most=8, few=few, salts=5)
        assert got.columns == ["key", "id", "count"] and sorted(map(tuple, got.collect())) == want


def test_nodes_with_one_half_of_a_digest(spark):
    nodes = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 10, "c")], "node long, check long, name string")
    plain = spark.createDataFrame([(1, 10, 100), (1, 11, 101), (2, 10, 102), (None, None, 103)], "node long, check long, doc_id long")
    a, b = near_dedup.told_apart(nodes, plain)
    names = {r["node"]: r["name"] for r in a.collect()}
    assert len(names) == 3 and {r["doc_id"]: names.get(r["node"]) for r in b.collect()} == {100: "a", 101: "b", 102: "c", 103: None}


def test_near_dedup_moves_only_the_sets_of_pairs(spark, tmp_path):
    from loomlake.llm.common import stored

    sets = stored(spark.range(1, 2001).selectExpr("id as node", "sequence(id, id + 9) as shingles"), str(tmp_path), "sets")
    links = near_dedup.Links(sets.selectExpr("node", "10l as n_shingles", "array(0l) as sketch"), sets, 75, 0)
    wanted = stored(spark.createDataFrame([(1,), (2,), (2,), (7,)], "node long"), str(tmp_path), "wanted")
    assert sorted(r["node"] for r in links.sets_for(wanted).collect()) == [1, 2, 7]
    filtered = [r["node"] for r in links.sets_for(wanted, few=0).collect()]  # a bit filter may let others pass
    assert {1, 2, 7} <= set(filtered) and len(filtered) < 100
    pairs = stored(spark.createDataFrame([(1, 2), (1, 7), (20, 21)], "a long, b long"), str(tmp_path), "pairs")
    assert sorted(tuple(r) for r in links.confirmed(pairs).collect()) == [(1, 2), (20, 21)]


def test_near_dedup_tests_a_pair_once_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    import time
    from pathlib import Path

    monkeypatch.setattr(near_dedup, "shared_dir", lambda spark: str(tmp_path / "near"))
    text = lambda name, low, n=60: " ".join(f"{name}{j}" for j in range(low, low + n))
    rows = [(2 * k + side, text(f"p{k}x", 10 * side)) for k in range(30) for side in (0, 1)]  # 46 of 66: just too far apart
    rows += [(100 + k, text("chain", 4 * k)) for k in range(60)]
    rows += [(200 + side, text("long", 80 * side, 6_000)) for side in (0, 1)] + [(300 + side, text("far", 950 * side, 6_000)) for side in (0, 1)]  # longer than shortened to 16 bits
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x.toString() for x in (disk.getAllBlocks().apply(k) for k in range(disk.getAllBlocks().size())) if x.isShuffle()}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    mode, before = spark.conf.get(key), shuffled()
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    end = time.time() + 20
    while (left := shuffled() - before) and time.time() < end:  # they are removed in the background
        time.sleep(0.5)
    assert not left and spark.conf.get(key) == mode
    assert sorted(map(tuple, found.collect())) == sorted(components(rows))
    rounds = [{frozenset((r["a"], r["b"])) for r in spark.read.parquet(str(p)).collect()} for p in sorted(Path(tmp_path, "near").glob("likely-*"), key=lambda p: int(p.name.partition("-")[2]))]
    assert len(rounds) > 1 and len(rounds[0]) >= 30
    assert sum(map(len, rounds)) == len(set().union(*rounds))


def test_near_dedup_ends_rounds_that_find_next_to_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "shared_dir", lambda spark: str(tmp_path / "near"))
    shared = " ".join(f"w{j}" for j in range(104))
    rows = [(k, shared + "".join(f" own{k}x{j}" for j in range(20))) for k in range(300)]  # 100 of 140: just too far apart
    rows += [(500 + k, " ".join(f"chain{j}" for j in range(8 * k, 8 * k + 60))) for k in range(5)]  # only neighbours are linked
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(components(rows))
    assert [p.name for p in sorted((tmp_path / "near").glob("likely-*"))] == ["likely-0"]


def test_shortened_sets_lose_no_link(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dedup, "SHORT", 300)
    made, rows = random.Random(5), []
    for k in range(300):
        n = made.choice([1, 2, 40, 220, 290, 300, 310, 390, 420, 900])
        a = {made.getrandbits(64) - (1 << 63) for _ in range(n)}
        apart = round(n * made.uniform(0.05, 0.25))
        b = set(sorted(a)[apart:]) | {made.getrandbits(64) - (1 << 63) for _ in range(made.randrange(apart + 1))}
        rows.append((k, sorted(a), sorted(b or a)))
    rows.append((300, [k << 40 for k in range(100)], [k << 40 for k in range(90)]))  # 16 bits tell none of them apart
    sets = spark.createDataFrame(rows, "node long, a_set array<long>, b_set array<long>")
    a, b = (near_dedup.shortened(sets.select("node", F.col(f"{s}_set").alias("shingles")), 75).toDF("node", f"{s}_short", f"{s}_wide") for s in "ab")
    both = sets.join(a, "node").join(b, "node").withColumns({f"{s}_n": F.size(f"{s}_set").cast("long") for s in "ab"})
    got = both.select("node", near_dedup.linked_sets(75).alias("linked"), near_dedup.maybe_linked(75).alias("may"), near_dedup.sized("a_n", "b_n", 75).alias("sized")).collect()
    # Sizes that rule a link out are told by themselves before sets are compared.
    assert all(r["may"] for r in got if r["linked"]) and sum(r["linked"] for r in got) > 50
    wrong = [r for r in got if r["sized"] and r["may"] and not r["linked"]]
    assert len(wrong) < 10 and sum(not r["may"] for r in got if r["sized"]) > 20

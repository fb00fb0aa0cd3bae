"""The classifiers' scores computed again, a text at a time in plain Python, and the balance of shards."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
import zstandard

from loomlake.llm import quality, sharding, toxicity
from loomlake.llm.labelled import labelled_sample

SF = "/root/testdata/sf0.001"
ODD = [(900_001, None), (900_002, ""), (900_003, " \t "), (900_004, "!!! ??? !!!"), (900_005, "one"), (900_006, " ".join(f"w{i}" for i in range(20_000))), (None, "no id")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    return docs, spark.read.parquet(f"{SF}/labels.parquet"), {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_samples_are_training_rows(spark, tables):
    docs, labels, texts = tables
    sample, counts = labelled_sample(docs, labels, "quality", {0: 10, 1: 10}, 4_000)
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and not held(r["doc_id"])}
    assert counts == dict(Counter(label.values()))
    allowed = Counter((texts[i], y) for i, y in label.items() if i in texts and len(texts[i].encode()) <= 4_000)
    assert sample and not Counter(sample) - allowed and max(Counter(y for _, y in sample).values()) <= 10


def test_quality_scores(spark, tables):
    docs, labels, texts = tables
    bits, settings = 12, {0: 60, 1: 60}
    weights, _ = quality.fit(*labelled_sample(docs, labels, "quality", settings, 16_384), bits, 3)
    same = xxhash.xxh64_intdigest(b"\0same")

    def score(text):
        ids = [xxhash.xxh64_intdigest(t.encode()) for t in re.findall(r"[^\W_]+|[^\w\s]+|_+", text.lower())]
        words = [same if k and ids[k] == ids[k - 1] else x for k, x in enumerate(ids)]
        pairs = [((a * 0x9E3779B97F4A7C15 % (1 << 64) ^ b) * 0xC2B2AE3D27D4EB4F) % (1 << 64) for a, b in zip(words, words[1:], strict=False)]
        grams = words + pairs
        x = sum(float(weights[g >> (64 - bits)]) for g in grams) / max(1, len(grams)) + float(weights[-1])
        return 1 / (1 + math.exp(-x))

    got = quality.score_quality(docs, labels, per_class=60, bits=bits, epochs=3).collect()
    assert len(got) == docs.count()
    for r in got:
        want = score(texts[r["doc_id"]])
        assert math.isclose(r["score"], want, rel_tol=1e-6) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"])


def test_ftrl_updates():
    """The vectorised learner against the update written out for one weight at a time."""
    rows = [({1: 0.5, 3: 2.0}, 1), ({1: 1.5}, 0), ({0: 1.0, 3: 0.25}, 1), ({1: 0.5, 2: 1.0}, 0)] * 3
    model = quality.Ftrl(2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= model.l1:
            return 0.0
        return -(z[k] - math.copysign(model.l1, z[k])) / ((model.beta + math.sqrt(n[k])) / model.alpha + model.l2)

    for features, label in rows:
        model.learn(list(features), list(features.values()), label)
        full = features | {4: 1.0}  # the bias
        w = {k: weight(k) for k in full}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in full.items())))
        for k, v in full.items():
            g = (p - label) * v
            s = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / model.alpha
            z[k] += g - s * w[k]
            n[k] += g * g
    assert all(math.isclose(float(model.weights()[k]), weight(k), abs_tol=1e-12) for k in range(5))


def test_toxicity_scores(spark, tables):
    docs, labels, texts = tables
    settings = dict(window=64, level=9, zs=(2.0, 3.0), times=3.0, sizes=(8_192, 1_024))
    sample, counts = labelled_sample(docs, labels, "toxic", {0: 100, 1: 100}, 16_384)
    model, constant = toxicity.fit(sample, counts, *settings.values())

    def size(content, data):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    def score(text):
        if model is None:
            return constant
        ordinary, toxic, weights = model
        found, held_back = [], b""
        for word in text.lower().encode().split():
            held_back += word + b" "
            if len(held_back) >= 64:
                found.append(b" " + held_back)
                held_back = b""
        found += [b" " + held_back] if held_back else []
        gain = sorted((size(ordinary, w) - size(toxic + ordinary, w) for w in found), reverse=True) or [0]
        numbers = [gain[0], sum(gain[:5]), sum(gain) / len(gain), sum(g >= 3 for g in gain) / len(gain)]
        x = sum(a * b for a, b in zip(numbers, weights[:-1], strict=True)) + weights[-1]
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

    got = toxicity.score_toxicity(docs, labels, toxic_rows=100, ordinary_rows=100, **settings).collect()
    assert len(got) == docs.count()
    for r in got:
        assert math.isclose(r["score"], score(texts[r["doc_id"]]), rel_tol=1e-9) and r["predicted"] == int(r["score"] >= 0.5)


def test_shards_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, shards=8).collect()
    loads, groups = Counter(), defaultdict(int)
    for r in rows:
        loads[r["shard"]] += r["size"]
        groups[r["text_crc32"], r["size"]] += r["size"]
    assert set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) <= 2 * max(groups.values())

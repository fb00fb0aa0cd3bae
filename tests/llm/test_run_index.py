"""Removal of repeated byte strings against counting every string."""

import hashlib
import random
from collections import Counter

import pytest

from loomlake.llm import run_index

SCHEMA = "doc_id long, text string, row string, key long, marks int, body string"


def prose(r, n):
    out = ""
    while len(out) < n:
        out += "".join(r.choice("abcdeéfg") for _ in range(r.randint(2, 7))) + " "
    return out[:n]


def counted(texts, window):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    for b in bodies:
        hit = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                hit[i : i + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, hit, strict=True) if not y)
        spans = sum(1 for i in range(len(hit)) if hit[i] and (i == 0 or not hit[i - 1]))
        yield len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()


def corpus():
    r = random.Random(1)
    p, short = [prose(r, 700) for _ in range(4)], prose(r, 330)
    texts = [None, "", "abc", p[0], p[0], "a" * 9000, "ab" * 300, "xy" + "a" * 401, p[1] + prose(r, 300) + p[1], prose(r, 50) + p[2] + prose(r, 60), p[2][100:] + prose(r, 500)]
    # One byte short of the window, exactly the window, and the window across a difference.
    texts += [p[3][:399], p[3][:399] + "q", prose(r, 10) + p[3][:400], prose(r, 9) + p[3][5:405] + "z", prose(r, 30_000)]
    # A short passage that many texts share, and near copies.
    texts += [prose(r, 40 + i) + short + prose(r, 200) for i in range(60)]
    texts += [p[1][:350] + prose(r, 5) + p[1][355:] for _ in range(20)] + [p[1]] * 3
    return [*enumerate(texts), (3, p[0]), (None, p[0]), (None, prose(r, 500))]


@pytest.mark.parametrize("limit", [run_index.LIMIT, 3000])
def test_removed_bytes(spark, limit):
    """With a small limit, keys that many different segments share are cut again down to whole windows."""
    rows = corpus()
    docs = spark.createDataFrame([(*r, None, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in run_index.digest(run_index.drop_repeats(docs, limit=limit)).collect()), key=str)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, counted([t for _, t in rows], run_index.WINDOW), strict=True)), key=str)


def test_bytes_that_are_left(spark):
    rows = corpus()[:16]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in run_index.drop_repeats(docs, with_bytes=True).collect():
        body, at, left = (dict(rows)[r["doc_id"]] or "").encode(), 0, b""
        for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True):
            left, at = left + body[at:a], b
        assert r["kept"] == left + body[at:] and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_short_window_on_empty_table(spark):
    assert run_index.drop_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_statistics_of_the_index():
    r = random.Random(3)
    pieces = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))).encode() for _ in range(30)] + [b"abab" * 20, b"a"]
    index = run_index.RunIndex(pieces)
    got, at = index.statistics(), 0
    assert index.runs < len(index.symbols)
    suffixes = [(k, i) for k, p in enumerate(pieces) for i in range(len(p))]
    for k, p in enumerate(pieces):
        for i in range(len(p)):
            best = 0
            for k2, i2 in suffixes:
                if (k, i) != (k2, i2):
                    q, n = pieces[k2], 0
                    while i + n < len(p) and i2 + n < len(q) and p[i + n] == q[i2 + n]:
                        n += 1
                    best = max(best, n)
            assert got[at + i] == best
        at += len(p) + 1

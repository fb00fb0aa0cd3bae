"""Backoff of several orders against the recursion written out a token at a time."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomlake.llm import backoff, katz

from .test_operators import awkward, empty, lower

NO_WORD = "\0none"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Model:
    """The model as its formulas say it, from plain counts."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            s = padded(text, order)
            for k in range(1, order + 1):
                self.counts[k].update(tuple(s[i - k + 1 : i + 1]) for i in range(order - 1, len(s)))
        self.n = sum(self.counts[1].values())
        self.d = [katz.discounts(dict(Counter(c.values()))) for c in self.counts]
        kept = sum(self.cut(1, c) * c for c in self.counts[1].values())
        whole = self.n if self.n - kept > 1e-9 * self.n else self.n + 1
        self.single = lambda w: self.cut(1, self.counts[1][w]) * self.counts[1][w] / whole if w in self.counts[1] else (whole - kept) / whole
        self.sums = {}
        for k in range(2, order + 1):
            seen = defaultdict(lambda: [0, 0.0, 0.0])
            for gram, c in self.counts[k].items():
                own = seen[gram[:-1]]
                own[0] += c
                own[1] += (1 - self.cut(k, c)) * c
                own[2] += self.p(gram[1:])
            self.sums |= {h: (n, b, s) if b > 0 else (n + 1, 1.0, s) for h, (n, b, s) in seen.items()}

    def cut(self, k, c):
        return self.d[k][c - 1] if 0 < c <= katz.K else 1.0

    def p(self, gram):
        k = len(gram)
        if k == 1:
            return self.single(gram)
        c, h = self.counts[k][gram], gram[:-1]
        if c:
            return self.cut(k, c) * c / self.sums[h][0]
        low = self.p(gram[1:])
        if h not in self.sums:
            return low
        n, b, s = self.sums[h]
        return b / n / (1 - s) * low


def padded(text, order):
    return ["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + ["</s>"]


def wanted(rows, order):
    model = Model([t for i, t in rows if not held(i)], order)
    v = len(model.counts[1])
    for h in list(model.sums)[::211]:  # every context sums to one
        assert math.isclose(sum(model.p((*h, *w)) for w in model.counts[1]) + model.p((*h, NO_WORD)), 1.0, rel_tol=1e-9)
    out = []
    for i, t in rows:
        s = padded(t, order)
        grams = [tuple(s[j - order + 1 : j + 1]) for j in range(order - 1, len(s))]
        counts = [model.counts[1][g[-1:]] for g in grams]
        out.append((i, held(i), len(grams), sum(c > 0 for c in counts), model.n, sum(math.log10((c + 1) / (model.n + v + 1)) for c in counts), sum(math.log10(model.p(g)) for g in grams)))
    return out


def same(got, want):
    for a, b in zip(sorted(map(tuple, got), key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_orders(spark, order):
    rows, docs = awkward(spark)
    same(katz.score(docs, order=order).collect(), wanted(rows, order))


def test_order_two_is_the_model_of_pairs(spark):
    rows, docs = awkward(spark)
    same(backoff.score(docs, 2).collect(), wanted(rows, 2))
    same(katz.score(docs, hot=200).collect(), [tuple(r) for r in backoff.score(docs, 2).collect()])


def test_grams_of_many_documents_are_dealt(spark):
    rows = [(i, "the same words stand here again and again") for i in range(700)] + [(i, f"other word{i % 7} stand here") for i in range(700, 730)] + [(i, "") for i in range(800, 805)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(katz.score(docs, order=3).collect(), wanted(rows, 3))


def test_no_rows_and_no_training_rows(spark):
    assert katz.score(empty(spark), order=3).count() == 0
    only = spark.createDataFrame([(i, "a b c") for i in range(40) if held(i)] or [(0, "a")], "doc_id long, text string")
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in katz.score(only, order=3).collect())
    with pytest.raises(ValueError):
        katz.score(only, order=0)

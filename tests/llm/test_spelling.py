"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from loomlake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, root string, key int"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {w: min((v for v in near[w] if words[v] >= 10 * words[w]), key=lambda v: (-words[v], v), default=None) for w in words}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), words.get(form[w])


def corpus():
    r = random.Random(5)
    letters = "abcdeé÷Àß"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(6, 12))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    words = []
    for stem in stems:
        chain = [stem]
        for _ in range(12):
            base, at = r.choice(chain), r.randint(0, 6)
            kind = r.randint(0, 2)
            chain.append(base[:at] + (r.choice(letters) if kind else "") + base[at + (kind < 2) :])
        for k, w in enumerate(chain):
            words += [w] * r.choice([1, 2, 3, 25, 260] if k else [300, 3000])
    r.shuffle(words)
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in words[a : a + 200]) + ".") for i, a in enumerate(range(0, len(words), 200))]
    return [*rows, (900, None), (901, ""), (902, "one-two, three1four"), (None, "ÀÀÀÀÀÀÀÀ Settings settings"), (5, rows[5][1]), (903, "settings " * 60_000)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 5])
def test_variants(spark, block):
    """With blocks of a few words, most keys are dealt over several and looked up in each."""
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    want = sorted(variants(rows))
    got = sorted(tuple(r) for r in spelling.group_variants(docs, block=block).collect())
    assert got == want
    assert sum(1 for w in want if w[1]) > 20 and any(w[1] != w[2] for w in want if w[1])


def test_empty(spark):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_position_index():
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(3, 8))) for _ in range(150)})
    index = spelling.PositionIndex(words)
    for word in [*words, "a" * 12]:
        assert [words[i] for i in index.near(word)] == [w for w in words if one_apart(word, w)]

"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-proximal updates.

A text is cut into words and runs of punctuation, in lower case; a token that repeats the one
before it counts as the token "same". Single tokens and pairs are hashed into 2**`bits` weights.
A document's value of a feature is the share of its n-grams that hash there, so a score is a
sparse dot product of any length of text with the weights, and needs one pass.

Training sees a bounded sample of labelled rows (`per_class` rows of each label with texts of at
most `longest` bytes, see labelled.py) on the driver; the weights, 2**`bits` numbers, are
broadcast. Scores are corrected for the sample's share of each label. All documents are scored,
whole, where they lie.

Defined cases: a very long text is scored by all its n-grams; a score at the threshold is predicted 1; null text counts as empty; a text without tokens scores by the bias alone; without
training rows of both labels every score is the share of label 1 among them, or 0.5; repeated rows
and rows without an id are scored like others; empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, portable
from .labelled import held_out, labelled_sample

portable(__name__)

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Hasher:
    """Hashed n-grams of texts; remembers the hashes of up to `remembered` tokens."""

    def __init__(self, bits: int, remembered: int = 500_000):
        import numpy as np
        import xxhash

        class Known(dict):
            def __missing__(self, token):
                if len(self) > remembered:
                    self.clear()
                self[token] = found = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
                return found

        self.np, self.known, self.shift = np, Known(), np.uint64(64 - bits)
        self.same = np.uint64(xxhash.xxh64_intdigest(b"\0same"))

    def __call__(self, text: str):
        """The weight indexes of all n-grams of a text, repeated ones repeated."""
        np = self.np
        tokens = TOKENS.findall(text.lower())
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        if len(ids) < 2:
            return ids >> self.shift
        words = ids.copy()
        words[1:][ids[1:] == ids[:-1]] = self.same
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.concatenate([words, pairs]) >> self.shift


class Ftrl:
    """Logistic regression by FTRL-proximal, a document at a time."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0001):
        import numpy as np

        self.np, self.alpha, self.beta, self.l1, self.l2 = np, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias

    def weights(self, at=slice(None)):
        np = self.np
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at, values, label: int) -> None:
        np = self.np
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ values)))))
        g = (p - label) * values
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def fit(sample: list[tuple[str, int]], counts: dict[int, int], bits: int, epochs: int, scale: float = 10.0):
    """Weights (the last is the bias), or None and a constant score."""
    import numpy as np

    seen = {label for _, label in sample}
    if len(seen) < 2:
        total = sum(counts.values())
        return None, counts.get(1, 0) / total if total else 0.5
    hasher, model = Hasher(bits), Ftrl(bits)
    rows = []
    for text, label in sample:
        h = hasher(text).astype(np.int64)
        at, n = np.unique(h, return_counts=True)
        rows.append((at, scale * n / max(1, len(h)), label))
    for _ in range(epochs):
        for row in rows:
            model.learn(*row)
    w = model.weights()
    n1 = sum(label for _, label in sample)
    w[-1] += math.log(counts[1] / counts[0]) - math.log(n1 / (len(sample) - n1))
    w[:-1] *= scale
    return w.astype(np.float32), None


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", per_class: int = 4_000, longest: int = 16_384, bits: int = 18, epochs: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    sample, counts = labelled_sample(docs, labels, label_col, {0: per_class, 1: per_class}, longest, id_col, text_col)
    weights, constant = fit(sample, counts, bits, epochs)
    sent = docs.sparkSession.sparkContext.broadcast((weights, constant))

    def make():
        import numpy as np
        import pyarrow as pa

        (w, c), hasher = sent.value, Hasher(bits)

        def score(text):
            if w is None:
                return c
            h = hasher(text)
            x = float(w[h.astype(np.int64)].sum(dtype=np.float64)) / max(1, len(h)) + float(w[-1])
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

        def step(batch):
            scores = pa.array([score(t or "") for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = map_batches(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

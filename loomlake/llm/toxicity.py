"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary documents, one on toxic
documents. The toxic one is trained on what sets toxic text apart: of each toxic document the
words that toxic documents hold significantly more often than ordinary ones (some standard errors,
`times` as often); trained on whole documents it would mostly repeat the common prose of both. The
ordinary dictionary stands behind both, so common prose compresses alike and lengths differ only
where the toxic dictionary helps.

Each document is cut, whole, into windows of whole words of about `window` bytes. A window's
evidence is its compressed length with the ordinary dictionary less that with the toxic one. Four
numbers of a document (its largest evidence, the five largest together, the mean, the share of
windows with at least three bytes) are turned into a probability by thresholds calibrated, as a
logistic regression, on labelled rows that trained no dictionary, and corrected for the sample's
share of each label.

Training sees a bounded sample of labelled rows on the driver (see labelled.py); the two
dictionaries, of fixed size, are broadcast.

Defined cases: a very long text is cut into as many windows as it has; a score of 0.5 is predicted toxic; null text counts as empty; an empty text has one window without evidence; without
training rows of both labels every score is the share of label 1 among them, or 0 without any;
repeated rows and rows without an id are scored like others; empty tables give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, portable
from .labelled import held_out, labelled_sample

portable(__name__)


def windows(text: str, size: int):
    """Whole lower-cased words, about `size` bytes at a time."""
    words, used = [], 0
    for word in text.lower().encode("utf-8", "surrogatepass").split():
        words.append(word)
        used += len(word) + 1
        if used >= size:
            yield b" " + b" ".join(words) + b" "
            words, used = [], 0
    if words:
        yield b" " + b" ".join(words) + b" "


class Distance:
    """Evidence of windows, and a document's four numbers."""

    def __init__(self, ordinary: bytes, toxic: bytes, window: int, level: int):
        import zstandard

        def compressor(content):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.ordinary, self.toxic, self.window = compressor(ordinary), compressor(toxic + ordinary), window

    def __call__(self, text: str) -> list[float]:
        found = [len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text, self.window)] or [0]
        return [max(found), sum(sorted(found)[-5:]), sum(found) / len(found), sum(x >= 3 for x in found) / len(found)]


def telling_words(toxic: list[list[bytes]], ordinary: list[list[bytes]], z: float, times: float) -> set[bytes]:
    """Words in significantly more toxic documents than ordinary ones."""
    a, b = Counter(w for d in toxic for w in set(d)), Counter(w for d in ordinary for w in set(d))
    m, n = len(toxic), len(ordinary)
    found = set()
    for word, k in a.items():
        p = (k + b[word]) / (m + n)
        error = math.sqrt(p * (1 - p) * (1 / m + 1 / n)) or 1.0
        if (k / m - b[word] / n) / error > z and k / m > times * b[word] / n:
            found.add(word)
    return found


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A zstandard dictionary of `size` bytes; of few samples, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[-size:] or b" " * 8


def logistic(rows, labels):
    """Weights for standardised columns and the bias, folded back to the raw columns."""
    import numpy as np

    x, y = np.asarray(rows, float), np.asarray(labels, float)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.01), 0.0]
    for _ in range(100):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6)
        move = np.linalg.solve(curve, slope)
        w -= move / max(1.0, float(np.abs(move).max()))
        if np.abs(move).max() < 1e-9:
            break
    return [*(w[:-1] / spread), w[-1] - float((w[:-1] * mean / spread).sum())]


def fit(sample: list[tuple[str, int]], counts: dict[int, int], window: int, level: int, zs: tuple[float, ...], times: float, sizes: tuple[int, int]):
    """(ordinary, toxic, weights), or None and a constant score.

    Two rows of three train dictionaries, the third calibrates; of the significance levels `zs`
    the one with the smallest loss there is taken.
    """
    import numpy as np

    by = {label: list(dict.fromkeys(t for t, y in sample if y == label)) for label in (0, 1)}
    if min(map(len, by.values())) < 3:
        total = sum(counts.values())
        return None, counts.get(1, 0) / total if total else 0.0
    train = {y: [t.lower().encode("utf-8", "surrogatepass") for k, t in enumerate(ts) if k % 3] for y, ts in by.items()}
    words = {y: [t.split() for t in ts] for y, ts in train.items()}
    ordinary = trained(train[0], sizes[0], 64)
    checks = [(t, y) for y, ts in by.items() for k, t in enumerate(ts) if not k % 3]
    y = np.array([y for _, y in checks])
    best = None
    for z in zs:
        telling = telling_words(words[1], words[0], z, times)
        apart = [b" " + b" ".join(w for w in d if w in telling) + b" " for d in words[1]]
        toxic = trained([d for d in apart if len(d) > 4], sizes[1], 16)
        measure = Distance(ordinary, toxic, window, level)
        rows = np.array([measure(t) for t, _ in checks], float)
        weights = logistic(rows, y)
        x = rows @ np.array(weights[:-1]) + weights[-1]
        loss = float(np.logaddexp(0, np.where(y == 1, -x, x)).mean())
        if best is None or loss < best[0]:
            best = loss, toxic, weights
    _, toxic, weights = best
    weights[-1] += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return (ordinary, toxic, [float(w) for w in weights]), None


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = 2_000, ordinary_rows: int = 4_000, longest: int = 16_384, window: int = 64, level: int = 9, zs: tuple[float, ...] = (5.0, 7.0, 9.0), times: float = 5.0, sizes: tuple[int, int] = (65_536, 2_048), keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; with `keep`, those rows of `docs` that score below 0.5."""
    sample, counts = labelled_sample(docs, labels, label_col, {0: ordinary_rows, 1: toxic_rows}, longest, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(fit(sample, counts, window, level, zs, times, sizes))

    def make():
        import pyarrow as pa

        model, constant = sent.value
        if model:
            ordinary, toxic, weights = model
            measure = Distance(ordinary, toxic, window, level)

        def score(text):
            if not model:
                return constant
            x = sum(a * b for a, b in zip([*measure(text), 1.0], weights, strict=True))
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

        def step(batch):
            scores = [score(t or "") for t in batch.column(text_at).to_pylist()]
            if keep:
                yield batch.filter(pa.array([x < 0.5 for x in scores]))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

        return step

    if keep:
        text_at = docs.columns.index(text_col)
        return map_batches(docs, make, docs.schema)
    text_at = 2
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = map_batches(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

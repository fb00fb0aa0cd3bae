"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def held_out(column: str = "doc_id", folds: int = 5):
    """Whether a row is kept from training: crc32 of the id as text, modulo `folds`, is 0."""
    return crc_mod(column, folds) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: dict[int, int], longest: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of sampled training rows, in a fixed order, and all training labels' counts.

    At most `per_class[label]` rows of each label are drawn, by a hash of the id, and of those the
    documents of at most `longest` bytes are used, so the driver gets a bounded number of bytes.
    A row that `labels` names more than once takes its largest label. Rows whose id's crc32 modulo
    `folds` is 0 are never read.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(*per_class) & ~held_out("id", folds))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for label, most in per_class.items():
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .filter(F.octet_length("text") <= longest)
        .join(F.broadcast(drawn), "id")  # at most the sum of per_class rows of two numbers
        .groupBy("id")
        .agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
    )
    return [(r["text"], r["label"]) for r in rows.collect()], counts

"""A training corpus from the documents table: five stages, each on all that the one before kept.

toxicity       documents that the classifier predicts toxic go
exact_dedup    of equal texts the document with the smallest id stays
near_dedup     of each group of near duplicates the document with the smallest id stays
decontaminate  documents with a benchmark passage go
pack           what is left is encoded and cut into sequences

The first four return the columns of their input, whatever their names: a stage sees id and text, and its own
columns get names that the input doesn't have. Rows to drop are written to the shared folder
first and, while they are few, broadcast; beyond that a bit filter of bounded size lets pass the texts of most
rows that stay, and only the others are joined. Rows are matched by id and a digest of the text, so a row is judged by its own text even where ids repeat or are missing.
Rows without an id come after all others; of rows that repeat an id and a text, or a text without
an id, one stays. Null texts count as empty; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from loomlake.llm.common import bit_filtered, shared_dir, stored, text_of
from loomlake.llm.queries import table, tokenizer_file

#: Rows to drop are broadcast up to this number (about 100 bytes each).
FEW = 200_000


def free(docs: DataFrame, name: str) -> str:
    """`name`, or it with marks behind it until no column of `docs` is called so (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chosen(docs: DataFrame, named: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    """`docs` less the rows that `named` names (left_anti), or those (left_semi); nulls are equal. on: columns of docs to those of named."""
    names = {c: free(docs, f"named_{k}") for k, c in enumerate(on.values())}
    other = named.select(*[F.col(c).alias(name) for c, name in names.items()])
    condition = F.lit(True)
    for mine, theirs in on.items():
        condition &= F.col(f"`{mine}`").eqNullSafe(F.col(names[theirs]))
    if named.count() <= FEW:
        return docs.join(F.broadcast(other), condition, how)
    mark, may = free(docs, "mark"), free(docs, "may")
    marked = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in on]))
    marked = bit_filtered(marked, other.select(F.xxhash64(*[names[c] for c in on.values()]).alias(mark)), mark, flag=may)
    found = marked.filter(F.col(may)).join(other, condition, how)
    if how == "left_anti":
        found = found.unionByName(marked.filter(~F.col(may)))
    return found.drop(mark, may)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with a key: the id, in an order-keeping form (no id: last), and a digest of the text."""
    id_ = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return docs.withColumn(key, F.concat(F.coalesce(id_, F.lit("~")), F.sha2(text_of("text"), 256)))


def without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """`docs`, which `keyed` made, less the rows whose keys `dropped` has as doc_id."""
    dropped = stored(dropped.select("doc_id").distinct(), shared_dir(docs.sparkSession), "dropped")
    return chosen(docs, dropped, {key: "doc_id"}, "left_anti").drop(key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digest = free(docs, "digest")
    on = {"doc_id": "doc_id", digest: "text_sha256"}
    found = exact_dedup.exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = stored(found.filter("not kept or n > 1"), shared_dir(spark), "copies")
    marked = docs.withColumn(digest, F.sha2(exact_dedup.normalised("text"), 256))
    rest, repeated = chosen(marked, found, on, "left_anti"), found.filter("kept")
    if not repeated.isEmpty():
        rest = rest.unionByName(chosen(marked, repeated, on, "left_semi").dropDuplicates(["doc_id", digest]))
    return rest.drop(digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = free(docs, "key")
    rows = keyed(docs, key)
    return without(rows, near_dedup.near_dedup(rows, id_col=key).filter("not kept and n_shingles > 0"), key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = free(docs, "key")
    rows = keyed(docs, key)
    found = decontamination.digest(decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key))
    return without(rows, found.filter("contaminated"), key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: Classifier, components and tokenizer are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Token counts for every context limit from an exact length histogram.

Documents are encoded where they lie, once, and aggregated by encoded length, so one pair of numbers for
each distinct length of a task is shuffled; the histogram is stored in the shared folder. Suffix sums over the histogram then answer, for each
length L taken as the context limit: how many documents are longer or as long, the tokens kept
when each text is cut at L (the sum of min(length, L)) and lost, and the share of documents that
fit, that is the quantile at which L lies. Limits between two lengths follow exactly: nothing
changes there but min(length, L), which is linear (`at_limits`).

The suffix sums go by ranges of `span` lengths: sums of whole ranges first (a window over as many
rows as the longest document has ranges), then sums inside each range, so no task sees the whole
histogram.

Defined cases: null text counts as empty; empty texts have length 0; a very long text is encoded whole, runs of white space of more than RUN characters apart from the rest, as the pieces they are; repeated rows count each, and
documents of equal length share a row; an empty table gives no rows; other columns are ignored, whatever their names. Special tokens'
strings in a text are ordinary text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, portable, shared_dir, stored

portable(__name__)

#: The pieces that the vocabulary's merges never cross; fixed value of the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space as the pieces mean it; fixed values of Unicode. The piece pattern goes down a level for each character of a run, so long runs must not reach it.
BLANKS, RUN = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000", 1_000


def counter(ranks_file: str, pieces: str = PIECES):
    """The function that gives a text's number of tokens."""
    import base64
    import re

    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("lengths", pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(f"[{BLANKS}]{{{RUN},}}")

    def count(text: str) -> int:
        n, at = 0, 0
        for run in long_run.finditer(text):
            # A run is one piece, but for its last character if something follows: that goes with what follows.
            stop = run.end() - (run.end() < len(text))
            n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : stop]))
            at = stop
        return n + len(encoding.encode_ordinary(text[at:]))

    return count


def lengths(docs: DataFrame, ranks_file: str, text_col: str = "text", pieces: str = PIECES) -> DataFrame:
    """The encoded length of each document: one column, n_tokens.

    ranks_file: a file of base64 tokens and ranks, at the same place on every executor.
    """

    def make():
        import pyarrow as pa

        count = counter(ranks_file, pieces)

        def step(batch):
            yield pa.RecordBatch.from_arrays([pa.array([count(x or "") for x in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

        return step

    return map_batches(docs.select(F.col(text_col).alias("text")), make, "n_tokens long")


def suffix_table(counted: DataFrame, span: int = 512) -> DataFrame:
    """From n_tokens per document: a row for each distinct length with totals for that limit.

    n_tokens, n_docs, docs_longer, docs_at_least, tokens_at_least, kept_tokens, lost_tokens,
    total_docs, total_tokens, fits (share of documents of at most n_tokens tokens).
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    histogram = stored(counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), shared_dir(counted.sparkSession), "histogram")
    histogram = histogram.withColumn("range", F.floor(F.col("n_tokens") / span))
    ranges = histogram.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    everything = Window.orderBy(F.col("range").desc())  # a row for each `span` tokens of the longest document
    above = ranges.select(
        "range",
        (F.sum("docs").over(everything) - F.col("docs")).alias("docs_above"),
        (F.sum("tokens").over(everything) - F.col("tokens")).alias("tokens_above"),
        F.sum("docs").over(Window.partitionBy()).alias("total_docs"),
        F.sum("tokens").over(Window.partitionBy()).alias("total_tokens"),
    )
    own = Window.partitionBy("range").orderBy(F.col("n_tokens").desc())
    sums = histogram.select(
        "n_tokens", "n_docs", "range", F.sum("n_docs").over(own).alias("docs_own"), F.sum(tokens).over(own).alias("tokens_own")
    ).join(above, "range")
    docs, kept_whole = F.col("docs_own") + F.col("docs_above"), F.col("tokens_own") + F.col("tokens_above")
    kept = F.col("total_tokens") - kept_whole + docs * F.col("n_tokens")
    return sums.select(
        "n_tokens",
        "n_docs",
        (docs - F.col("n_docs")).alias("docs_longer"),
        docs.alias("docs_at_least"),
        kept_whole.alias("tokens_at_least"),
        kept.alias("kept_tokens"),
        (F.col("total_tokens") - kept).alias("lost_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - docs + F.col("n_docs")) / F.col("total_docs")).alias("fits"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_longer, kept_tokens, lost_tokens for any limits, from `suffix_table`.

    A limit's answer lies at the smallest length at or above it; above all lengths nothing is lost.
    """
    asked = table.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    least = F.min_by(F.struct("docs_at_least", "tokens_at_least", "n_tokens", "n_docs", "docs_longer"), F.col("n_tokens"))
    totals = table.agg(F.max("total_tokens").alias("total_tokens"))
    found = (
        asked.join(table, table["n_tokens"] >= asked["context_limit"], "left")
        .groupBy("context_limit")
        .agg(least.alias("at"))
        .crossJoin(F.broadcast(totals))  # one row
    )
    docs = F.coalesce(F.col("at.docs_at_least"), F.lit(0))
    lost = F.coalesce(F.col("at.tokens_at_least") - docs * F.col("context_limit"), F.lit(0))
    longer = F.when(F.col("at.n_tokens") == F.col("context_limit"), F.col("at.docs_longer")).otherwise(docs)
    return found.select("context_limit", longer.alias("docs_longer"), (F.col("total_tokens") - lost).alias("kept_tokens"), lost.alias("lost_tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents doesn't exceed."""
    asked = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(table, table["fits"] >= asked["share"]).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))

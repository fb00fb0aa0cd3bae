"""Packing by power-of-two decomposition.

A document's token ids (with an end id) are cut into pieces whose lengths are powers of two: as
many pieces of `longest` as fit, then the binary digits of the rest, largest first. Each piece is
a sequence of its own, and sequences of equal length share a bucket, so no sequence crosses
documents and none is padded. `sequence_id` numbers sequences within and across buckets: bucket b
(length 2**b) holds the ids from b * 2**48.

Encoding a document needs nothing of others; only the pieces (seven numbers each) are stored in the
shared folder and shuffled to be numbered. Chunks between blanks are encoded once in each task and looked up
after that; texts with characters outside ASCII and Latin letters, for which cutting words by
Python's rules and by the tokenizer's might differ, are encoded whole by the tokenizer.

Defined cases: null text counts as empty; an empty text has the end id only, one piece of length 1;
a very long text is encoded whole and has as many pieces as it needs; repeated rows are packed each; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, numbered, portable, shared_dir, stored

portable(__name__)

#: Characters for which words are cut alike: ASCII but for separators, Latin letters, some marks.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-įı-ɏ–—‘’“”…]*")
#: Words of such texts, in lower case; fixed value of the vocabulary (its word pattern for these characters).
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
FIRST = 1 << 48
LONG = 64  # characters of words that are remembered
HELD = 1 << 25  # characters of chunks that are remembered together


class Recent(dict):
    """A dict that fills missing keys by `make`; of two generations of at most `most` keys the older goes."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(key) > LONG:
            return self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class Encoder:
    """Token ids of texts; remembers the ids of up to `remembered` chunks between blanks, and of as many words.

    No token spans a blank, so the ids of a text are those of its chunks in a row.
    """

    def __init__(self, tokenizer_file: str, remembered: int = 250_000):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.np, self.tokenizer, self.remembered = np, Tokenizer.from_file(tokenizer_file), remembered
        merge = self.tokenizer.model.tokenize
        # What the tokenizer does with one word: bytes as characters, then merges.
        self.words = Recent(lambda w: [t.id for t in merge(w if w.isascii() else spell(w)[0][0])], remembered)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.clear()

    def clear(self) -> None:
        """Forget the chunks."""

        class Numbers(dict):
            def __missing__(self, chunk):
                self[chunk] = found = len(self)
                return found

        np = self.np
        self.number, self.known, self.filled, self.held = Numbers(), 0, 0, 0
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def put(self, name: str, at: int, values) -> None:
        """Write values at a place of an array that doubles when it is full."""
        array = getattr(self, name)
        if at + len(values) > len(array):
            array = self.np.append(array, self.np.zeros(max(len(array), len(values)), array.dtype))
            setattr(self, name, array)
        array[at : at + len(values)] = values

    def learn(self) -> None:
        """The ids of the chunks that have numbers only."""
        np = self.np
        fresh = list(itertools.islice(self.number, self.known, None))
        encoded = [[i for w in WORDS.findall(chunk) for i in self.words[w]] for chunk in fresh]
        self.held += sum(map(len, fresh))
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        self.put("starts", self.known, np.cumsum(sizes) - sizes + self.filled)
        self.put("sizes", self.known, sizes)
        self.put("ids", self.filled, ids)
        self.known, self.filled = self.known + len(encoded), self.filled + len(ids)

    def encode(self, texts: list[str]) -> list:
        """An array of uint32 ids for each text."""
        np = self.np
        if len(self.number) > self.remembered or self.held > HELD:
            self.clear()
        number, at = self.number.__getitem__, []
        for text in texts:
            if PLAIN.fullmatch(text) and not self.special.search(text):
                chunks = text.lower().split()
                at.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
            else:
                at.append(None)
        self.learn()
        out = []
        for text, own in zip(texts, at, strict=True):
            if own is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            size = self.sizes[own]
            ends = np.cumsum(size)
            out.append(self.ids[np.repeat(self.starts[own] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)])
        return out


def cut_sizes(n: int, longest: int) -> list[int]:
    """Powers of two, at most `longest`, that add up to n, largest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if (n % longest) >> b & 1]


def pieces(docs: DataFrame, tokenizer_file: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) for each piece of each document.

    tokenizer_file: a tokenizers JSON file, at the same place on every executor.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def make():
        import os
        import zlib

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_file)

        def step(batch):
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield from some(part.column("doc_id"), [t or "" for t in part.column("text").to_pylist()])

        def some(doc_ids, texts):
            row, start, length, crc, tokens, own = [], [], [], [], [], []
            for k, ids in enumerate(encoder.encode(texts)):
                ids, at = np.append(ids, np.uint32(end_id)).astype("<u4"), 0
                data = memoryview(ids).cast("B")
                for n in cut_sizes(len(ids), longest):
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    if with_ids:
                        own.append(ids[at : at + n])
                    at += n
                row += [k] * (len(start) - len(row))
                tokens += [len(ids)] * (len(start) - len(tokens))
            columns = [doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(own, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return map_batches(rows, make, schema)


def pack(docs: DataFrame, tokenizer_file: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; each piece is one sequence."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_file, longest, end_id, id_col, text_col, with_ids), shared_dir(spark), "pieces")
    own = numbered(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "__number")
    bucket = F.log2(F.col("length").cast("double")).cast("long")
    return own.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (bucket * F.lit(FIRST) + F.col("__number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )

"""Helpers shared by the operators: shared folder, text hashes, numbering, Arrow maps."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def portable(module: str) -> None:
    """Send this module's functions to the executors by value.

    Python workers then need no copy of the package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


portable(__name__)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in `spark.checkpoint.dir`; where the session has none (tests in local mode), a
    temporary folder of this machine is set for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, lost executors cost nothing.

    rows: about how many `df` has at most; then tasks and files are one for each `each` of them, or fewer.
    """
    path = f"{folder}/{name}"
    (df if rows is None else df.coalesce(1 + rows // each)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.

    For work that is stored step by step, so that no plan runs twice (one that does is computed again).
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_mod(column: str | Column, divisor: int) -> Column:
    """crc32 of an id's decimal digits, modulo `divisor` (null: of the empty text)."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % divisor


def numbered(df: DataFrame, key: list[str], order: list[str], name: str, chunks: int = 1024) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in no single task.

    Rows are dealt to `chunks` parts of each key by a hash of `order`; parts are counted first,
    so each starts where the ones before it end, and rows are numbered inside their part. A key
    that holds a third of all rows is spread over all its parts. `df` is evaluated twice, so it
    must be deterministic and cheap (or stored). The count table has keys x chunks rows.
    """
    part = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = part.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    # The window runs over at most `chunks` rows of a key.
    before = "sum(__n) over (partition by {k} order by __part rows between unbounded preceding and 1 preceding)".format(
        k=", ".join(f"`{k}`" for k in key)
    )
    starts = counts.select(*key, "__part", F.coalesce(F.expr(before), F.lit(0)).alias("__start"))
    rank = "row_number() over (partition by {k} order by {o})".format(
        k=", ".join(f"`{k}`" for k in [*key, "__part"]), o=", ".join(f"`{o}`" for o in order)
    )
    ranked = part.withColumn("__rank", F.expr(rank))
    return (
        ranked.join(starts, [*key, "__part"])
        .withColumn(name, (F.col("__start") + F.col("__rank") - 1).cast("long"))
        .drop("__part", "__start", "__rank")
    )


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: list[str], most: int = 256, few: int = 200_000, salts: int = 64) -> DataFrame:
    """`rows` joined with `table`, which has each key once and in `weight` how many rows have it.

    A key with more than `most` rows is dealt over tasks by a hash of the columns `spread`, and its row of `table` is
    repeated for each. Such keys are broadcast up to `few` (a long and two keys each); beyond that every
    key is dealt over `salts`.
    """
    parts = F.ceil(F.col(weight) / most).cast("int")
    large = table.filter(F.col(weight) > most).select(key, parts.alias("__parts"))
    if large.count() <= few:
        rows = rows.join(F.broadcast(large), key, "left")
        n = F.coalesce("__parts", F.lit(1))
    else:
        rows, n, parts = rows.withColumn("__parts", F.lit(salts)), F.lit(salts), F.lit(salts)
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*spread), n).cast("int")).drop("__parts")
    dealt = table.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.join(dealt, [key, "__part"]).drop("__part")


def bit_filtered(rows: DataFrame, keys: DataFrame, column: str, bits: int = 25, flag: str | None = None) -> DataFrame:
    """The rows whose `column` may be among that of `keys`: all that are, and of the others about one in 2**bits / number of keys.

    Each key sets one of 2**bits bits (4 MB), so what is broadcast is bounded at any size; where keys are too many for
    it, more rows pass, and none that is wanted is lost. With `flag` all rows come back, and that column says whether they passed.
    """
    place = F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    bucket, bits_, name = "__bucket", "__bits", flag or "__may"
    while {bucket, bits_} & {c.lower() for c in rows.columns}:
        bucket, bits_ = bucket + "_", bits_ + "_"
    maps = (
        keys.select(place.alias("__bit"))
        .groupBy(F.bitmap_bucket_number("__bit").alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias(bits_))
    )
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits_), F.expr("cast(0 as int)") + (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    out = rows.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(maps), bucket, "left").withColumn(name, found).drop(bucket, bits_)
    return out if flag else out.filter(F.col(name)).drop(name)


#: Rows and bytes of an Arrow batch at most: texts may be long, and a batch is held several times on its way.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str | T.StructType) -> DataFrame:
    """Run `make()` once in each task and its result on each Arrow batch of at most BATCH_ROWS rows and about BATCH_BYTES.

    The session keeps these settings: plans read them when they run, which is after this call.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        value = conf.get(key)
        if not value.isdigit() or not 0 < int(value) <= most:
            conf.set(key, str(most))

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)

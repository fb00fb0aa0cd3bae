"""Records stored by collection, with their JSON parsed once into a VARIANT column.

`path`/data has a folder for each collection, and inside it buckets by URI, as many as the collection's size is worth; `path`/layout says how many. Scans of some
collections read their folders only, lookups by URI in a collection one bucket. A batch of changes rewrites the buckets it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uris import collection_of
from ..schemas import RECORDS
from ..shared import shared_dir, stored

STORED = RECORDS + ", payload variant, bucket int"
LAYOUT = "collection string, buckets int"
#: Records of a bucket, about.
BUCKET = 1_000_000
#: Buckets of a collection at most, as the driver handles a bucket's folder by itself; beyond that buckets grow.
MOST_BUCKETS = 1_024


def bucket_of(uri: Column | str, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(uri), buckets).cast("int")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """collection, buckets: a row for each collection."""
    return spark.read.schema(LAYOUT).parquet(f"{path}/layout")


def write(records: DataFrame, path: str, per_bucket: int = BUCKET) -> None:
    """Store a whole table of records. A collection with a third of all rows is spread over its buckets."""
    spark = records.sparkSession
    sizes = records.groupBy("collection").agg(F.greatest(F.lit(1), F.least(F.lit(MOST_BUCKETS), F.ceil(F.count(F.lit(1)) / per_bucket))).cast("int").alias("buckets"))
    sizes.write.mode("overwrite").parquet(f"{path}/layout")
    placed(records, layout(spark, path)).write.mode("overwrite").partitionBy("collection", "bucket").parquet(f"{path}/data")


def placed(records: DataFrame, sizes: DataFrame) -> DataFrame:
    """`records` with payload and bucket, brought together by folder in parts of an even size."""
    return bucketed(records, sizes).hint("rebalance", "collection", "bucket")


def bucketed(records: DataFrame, sizes: DataFrame) -> DataFrame:
    found = records.join(sizes, "collection").withColumn("bucket", bucket_of("uri", F.col("buckets"))).drop("buckets")
    return found.withColumn("payload", F.try_parse_json("json"))


def read(spark: SparkSession, path: str, collections: list[str] | None = None) -> DataFrame:
    """Stored records; with `collections` only their folders are read."""
    found = spark.read.schema(STORED).parquet(f"{path}/data")
    return found.filter(F.col("collection").isin(collections)) if collections else found


def apply(spark: SparkSession, path: str, changed: DataFrame, deleted: DataFrame | None = None) -> None:
    """Put records in (by URI; one row each) and take URIs out; only the buckets they lie in are read and written.

    New collections get one bucket. What a touched bucket holds afterwards is written aside, its rows brought together, so a bucket's files are as
    many as its size is worth; then its folder takes the place of the old one, or nothing does if it lost all its rows.
    """
    folder = shared_dir(spark)
    # Evaluated once: they may come from joins, or from this store.
    changed = stored(changed, f"{folder}/changed")
    deleted = None if deleted is None else stored(deleted.select("uri"), f"{folder}/deleted")
    known = layout(spark, path)
    new = changed.select("collection").distinct().join(known, "collection", "left_anti").withColumn("buckets", F.lit(1))
    sizes = stored(known.unionByName(new), f"{folder}/layout")
    gone = changed.select("uri") if deleted is None else changed.select("uri").unionByName(deleted)
    touched = gone.select("uri", collection_of("uri").alias("collection")).unionByName(changed.select("uri", "collection")).join(sizes, "collection")
    touched = stored(touched.select("collection", bucket_of("uri", F.col("buckets")).alias("bucket")).distinct(), f"{folder}/touched")
    old = read(spark, path).join(touched, ["collection", "bucket"], "left_semi").join(gone, "uri", "left_anti")
    # Beside the data, so that folders are only renamed.
    aside = f"{path}/aside/{uuid.uuid4().hex}"
    whole = old.unionByName(bucketed(changed, sizes).select(old.columns)).hint("rebalance", "collection", "bucket")
    whole.write.partitionBy("collection", "bucket").parquet(aside)
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in touched.toLocalIterator():
        name = f"collection={escaped(row['collection'])}/bucket={row['bucket']}"
        replace(spark, f"{aside}/{name}", f"{path}/data/{name}")
    remove(spark, aside)
    sizes.write.mode("overwrite").parquet(f"{path}/layout")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the store, wherever it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another, which goes even if there is none to come."""
    remove(spark, target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path(source)):
        files.mkdirs(path(target).getParent())
        if not files.rename(path(source), path(target)):
            raise OSError(f"{source} can't be renamed to {target}")


def folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """The values of a table's partition folders key=value, from the file system alone."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{key}="))

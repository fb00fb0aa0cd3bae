"""Scores when whole blocks of documents repeat."""

import math

from loomlake.llm import katz

SF = "/root/testdata/sf0.001"


def test_equal_blocks_count_once_each(spark):
    few = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    twice = spark.createDataFrame(spark.sparkContext.parallelize(few + few, 2), "doc_id long, text string")  # two partitions, each a block
    assert twice.rdd.getNumPartitions() == 2
    apart, together = (sorted(map(tuple, katz.score(df, hot=200, entries=5_000, common=4).collect())) for df in (twice, twice.coalesce(1)))
    assert len(apart) == len(together) == 80
    for a, b in zip(apart, together, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)

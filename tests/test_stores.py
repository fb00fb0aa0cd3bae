"""Stored forms: what plans read, and that results equal those without them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlake.operators import filters as W
from loomlake.operators import pages as P
from loomlake.operators import search_index as X
from loomlake.schemas import RECORDS
from loomlake.sources import activity_log as A
from loomlake.sources import record_store as R
from loomlake.streaming import rollups as U

T0 = datetime(2026, 1, 1)


def records(spark, rows):
    """rows: (collection, key, cid, json)."""
    full = [(f"at://d{k % 3}/{c}/{k}", cid, f"d{k % 3}", c, str(k), json, T0 + timedelta(minutes=k), T0 if k % 2 else None) for c, k, cid, json in rows]
    return spark.createDataFrame(full, RECORDS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_their_collections_only(spark, tmp_path):
    whole = records(spark, [("a.b.big", k, "x", '{"n":%d,"items":[{"u":"%d"}]}' % (k, k % 4)) for k in range(40)] + [("a.b.other", 100 + k, "x", "no json" if k else '{"n":1}') for k in range(3)])
    path = str(tmp_path / "r")
    R.write(whole, path, per_bucket=10)
    assert {r["collection"]: r["buckets"] for r in R.layout(spark, path).collect()} == {"a.b.big": 4, "a.b.other": 1}
    found = R.read(spark, path)
    assert sorted(map(str, found.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert found.filter("collection = 'a.b.other' and payload is null").count() == 2
    for scan in (P.newest(found, "a.b.big", 5), P.timeline(W.timeline_scope(found, ["a.b.big"])), R.read(spark, path, ["a.b.big"])):
        filters = plan(scan).split("PartitionFilters: [")[1].split("]")[0]
        assert "collection" in filters and "a.b.big" in filters
    newest = [r["uri"] for r in P.newest(found, "a.b.big", 5).collect()]
    assert newest == [r["uri"] for r in P.newest(whole, "a.b.big", 5).collect()]


def test_filters_and_pages_parse_nothing(spark, tmp_path):
    texts = ['{"a":"x","n":1,"c":{"d":"y"},"items":[{"u":"1","v":"p"},{"u":"2","v":"q"}]}', '{"a":null,"n":12,"items":[{"u":"1","v":"q"}]}', '{"n":2}', "no json", '{"a":"Xy","n":-3,"c":{"d":null}}', "{}"]
    whole = records(spark, [("a.b.c", k, "x", t) for k, t in enumerate(texts)])
    path = str(tmp_path / "r")
    R.write(whole, path)
    found, fields = R.read(spark, path), {"a": "string", "n": "integer"}
    for tests in ({"a": {"eq": "x"}}, {"n": {"gt": 1}, "a": {"isNull": True}}, {"c.d": {"eq": "y"}}, {"items": {"any": {"u": {"eq": "1"}, "v": {"eq": "q"}}}}, {"a": {"startsWith": "X"}}, {"n": {"in": [2, 12]}}, {"a": {"isNull": False}, "n": {"lte": 1}}):
        mine = W.where(found, tests, fields, payload="payload")
        assert "parse_json" not in plan(mine) and "from_json" not in plan(mine) and "get_json_object" not in plan(mine)
        assert {r["uri"] for r in mine.collect()} == {r["uri"] for r in W.where(whole, tests, fields).collect()}, tests
    for direction in ("ASC", "DESC"):
        mine = P.page(found, first=4, field="n", numeric=True, direction=direction, payload="payload")
        assert "json(" not in plan(mine.rows) and "get_json_object" not in plan(mine.rows)
        assert [r["uri"] for r in mine.rows.collect()] == [r["uri"] for r in P.page(whole, first=4, field="n", numeric=True, direction=direction).rows.collect()]
        rows, info = mine.read()
        assert [r["uri"] for r in rows] == [r["uri"] for r in mine.rows.collect()] and info == mine.info() == {"hasNextPage": True, "hasPreviousPage": False}


def test_changes_rewrite_touched_buckets_only(spark, tmp_path):
    whole = records(spark, [("a.b.big", k, "x", "{}") for k in range(60)] + [("a.b.small", 100, "x", "{}")])
    path = str(tmp_path / "r")
    R.write(whole, path, per_bucket=10)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "r" / "data").rglob("part-*.parquet")}
    changed = records(spark, [("a.b.big", 7, "y", '{"v":1}'), ("a.b.new", 200, "z", "{}")])
    R.apply(spark, path, changed, whole.filter("rkey in ('100', '8')").select("uri"))
    got = {(r["collection"], r["rkey"]): r["cid"] for r in R.read(spark, path).collect()}
    want = {("a.b.big", str(k)): "x" for k in range(60) if k != 8} | {("a.b.big", "7"): "y", ("a.b.new", "200"): "z"}
    assert got == want
    after = set((tmp_path / "r" / "data").rglob("part-*.parquet"))
    same = {p.parent for p in before if p in after}
    assert len(same) >= 3 and not (tmp_path / "r" / "data" / "collection=a.b.small" / "bucket=0").exists()
    assert {r["collection"] for r in R.layout(spark, path).collect()} == {"a.b.big", "a.b.small", "a.b.new"}


def test_touched_buckets_keep_few_files(spark, tmp_path, monkeypatch):
    """Rows come out of joins by URI: a bucket must not get a file from each of their tasks, and folders are bounded."""
    whole = records(spark, [("a.b.big", k, "x", "{}") for k in range(400)])
    path = str(tmp_path / "r")
    monkeypatch.setattr(R, "MOST_BUCKETS", 8)
    R.write(whole, path, per_bucket=10)
    assert [r["buckets"] for r in R.layout(spark, path).collect()] == [8]
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    for name, value in zip(names, ("-1", "-1", "false"), strict=True):
        spark.conf.set(name, value)
    try:
        stored = R.read(spark, path)
        R.apply(spark, path, stored.filter("rkey % 3 = 1").drop("payload", "bucket").withColumn("cid", F.lit("y")), stored.filter("rkey % 3 = 2"))
    finally:
        for name in names:
            spark.conf.unset(name)
    assert {r["rkey"]: r["cid"] for r in R.read(spark, path).collect()} == {str(k): "xy"[k % 3] for k in range(400) if k % 3 < 2}
    assert {len(list(p.glob("part-*.parquet"))) for p in (tmp_path / "r" / "data").glob("*/bucket=*")} == {1}


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    texts = ['{"t":"Licensed under X"}', '{"t":"nothing"}', '{"t":"LICENSE"}', '{"t":"100% ünïcode ÀB"}', '{"t":"under  licensed"}', '{"t":"aaaaaa"}', "", None, '{"t":"lic ens ed"}', '{"t":"\U0001f600 smile \U0001f600\U0001f600"}']
    whole = records(spark, [("a.b.c" if k % 3 else "a.b.d", k, "x", t) for k, t in enumerate(texts)])
    path = str(tmp_path / "i")
    X.write(whole, path)
    for text in ("licensed", "LICENSE", "100%", "ïco", "àb\"", "aaaa", "aaaaaaa", "zzz", " un", '"t":', "er  l", "\U0001f600\U0001f600\"", "e \U0001f600"):
        for collection in (None, "a.b.c", "a.b.d", "a.b.none"):
            assert {r["uri"] for r in X.search(whole, path, text, collection).collect()} == {r["uri"] for r in W.search(whole, text, collection).collect()}, (text, collection)
    with pytest.raises(ValueError):
        X.search(whole, path, "ab")
    found = X.candidates(spark, path, X.rarest(spark, path, "licensed", "a.b.c"), "a.b.c")
    filters = plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert "collection" in filters and "slot" in filters


def test_old_days_of_the_log_go_as_folders(spark, tmp_path):
    rows = [(k, T0 + timedelta(hours=6 * k), "create") for k in range(60)]
    log, path = spark.createDataFrame(rows, "id long, timestamp timestamp, operation string"), str(tmp_path / "log")
    A.append(log.filter("id < 30"), path, 0)
    A.append(log.filter("id >= 20 and id < 30"), path, 1)
    A.append(log.filter("id >= 30"), path, 1)  # the batch again, with other rows of other days
    A.append(log.filter("id < 30"), path, 0)
    assert A.read(spark, path).filter("id >= 30 or id < 20").count() == 50
    as_of = T0 + timedelta(hours=6 * 59, minutes=5)
    kept = A.retained(spark, path, as_of, days=3)
    assert sorted({r["id"] for r in kept.collect()}) == [r[0] for r in rows if r[1] >= as_of - timedelta(days=3)]
    first = (as_of - timedelta(days=3)).date()
    assert sorted(p.name for p in (tmp_path / "log").glob("day=*"))[0] == f"day={first}"
    assert "day" in plan(A.read(spark, path, since=as_of - timedelta(days=1))).split("PartitionFilters: [")[1].split("]")[0]


def test_rollups_are_signed_and_sketches_unite(spark, tmp_path):
    schema = "seq long, collection string, did string, old_day date, new_day date"
    day = lambda n: (T0 + timedelta(days=n)).date()
    one = [(k, "c", f"d{k % 700}", None, day(k % 2)) for k in range(3000)]
    two = [(5000 + k, "c", f"d{k % 700}", day(k % 2), None) for k in range(0, 1000)] + [(7000, "c", "d0", day(0), day(5)), (7001, "e", "x", None, day(1)), (7002, "e", "x", day(1), None)]
    folder = str(tmp_path / "u")
    for batch in (one, two):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        U.keep(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    assert {(r["collection"], str(r["date"])): r["count"] for r in U.by_day(spark, f"{folder}/out").collect()} == {("c", str(day(0))): 999, ("c", str(day(1))): 1000, ("c", str(day(5))): 1}
    assert [(str(r["date"]), r["cumulative"]) for r in U.time_series(spark, f"{folder}/out").orderBy("date").collect()] == [(str(day(0)), 999), (str(day(1)), 1999), (str(day(5)), 2000)]
    authors = {r["collection"]: r["authors"] for r in U.by_collection(spark, f"{folder}/out").collect()}
    assert abs(authors["c"] - 700) <= 3 * U.ERROR * 700 and authors["e"] == 1


def test_index_deals_texts_over_tasks(spark, tmp_path):
    """One file, which one task reads: its texts are cut by many. Line ends are part of trigrams."""
    whole = records(spark, [("a.b.c", k, "x", f"line\n{k}") for k in range(50)]).coalesce(1)
    assert whole.rdd.getNumPartitions() == 1 and X.dealt(whole).rdd.getNumPartitions() > 1
    X.write(whole, str(tmp_path / "i"))
    assert {r["rkey"] for r in X.search(whole, str(tmp_path / "i"), "E\n7", "a.b.c").collect()} == {"7"}

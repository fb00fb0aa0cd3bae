"""The pipeline's stages, each against plain Python on its own input."""

import re

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomlake.llm import decontamination, toxicity  # noqa: E402

from .test_operators import components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            assert {r["doc_id"] for r in out.collect()} == set(kept)
            break
        assert out.columns == columns
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
            want = {i: t for i, t in kept.items() if i not in bad}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(kept):
                first.setdefault(" ".join(kept[i].split()), i)
            want = {i: kept[i] for i in first.values()}
        elif name == "near_dedup":
            want = {i: kept[i] for i, n, _, keeps in components(sorted(kept.items())) if keeps or not n}
        else:
            cut = lambda t: re.findall(decontamination.WORD, "".join(c.lower() if c.isascii() else c for c in t or ""))
            items = [cut(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            passages = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
            sizes = {len(x) for x in passages}
            found = lambda w: any(tuple(w[k : k + n]) in passages for n in sizes for k in range(len(w) - n + 1))
            want = {i: t for i, t in kept.items() if not found(cut(t))}
            assert len(want) < len(kept)
        assert rows == want
        docs, kept = out, rows
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_many_rows_to_drop(spark, monkeypatch):
    """Past the limit for a broadcast, rows go through the bit filter and come out the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' as __bucket", "1 as mark", "doc_id as may")
    want = {name: [tuple(r) for r in stage(spark, docs, SF).orderBy("doc_id").collect()] for name, stage in corpus_pipeline.STAGES[1:4]}
    monkeypatch.setattr(corpus_pipeline, "FEW", 0)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert [tuple(r) for r in stage(spark, docs, SF).orderBy("doc_id").collect()] == want[name], name
        assert len(want[name]) < docs.count()


def test_empty_and_odd_rows(spark):
    full = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "x", 0), (2, "some words", "en", "x", 3), (2, "some words", "en", "x", 3)], full.schema)
    for start, least in ((full.limit(0), 0), (odd, 1)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= least


def test_rows_are_judged_by_their_own_text(spark):
    words = lambda k: " ".join(f"{k}{n}" for n in range(60))
    near = lambda k: words(k).replace(f"{k}59", "other")
    passage = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [
        (1, "some words"), (1, "some words"), (1, "some  words"), (None, "no id"), (None, "no id"), (None, words("a")), (9, words("a")),
        (None, near("b")), (3, words("b")), (None, passage), (4, passage), (4, "clean and different"),
        (5, words("c")), (6, near("c")), (6, "kept beside a near copy"), (-2, words("d")), (8, near("d")), (7, None), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
    left = [(i, " ".join((t or "").split())) for i, t in docs.select("doc_id", "text").collect()]
    want = [(1, "some words"), (None, "no id"), (9, words("a")), (3, words("b")), (4, "clean and different"), (5, words("c")), (6, "kept beside a near copy"), (-2, words("d")), (7, "")]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_clashing_columns_come_through(spark):
    names = ["__digest", "__key", "__drop_doc_id", "digest", "Key", "named_0", "named_1_", "text_sha256", "kept", "n", "copy", "label", "held_out", "n_shingles"]
    plain = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null")
    docs = plain.selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    want = plain
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs, want = stage(spark, docs, SF), stage(spark, want, SF)
        assert docs.columns == [*plain.columns, *names], name
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in want.collect()}
    assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)

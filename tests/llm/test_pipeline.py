"""Models on held-out rows, and the pipeline stage by stage against plain versions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medloom.llm import queries, quality

from . import plain

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_queries_are_complete():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize(("name", "label", "least"), [
    ("op4_toxicity", "toxic", 0.93), ("op8_quality", "quality", 0.95),
])
def test_held_out_labels(spark, name, label, least):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = queries.QUERIES[name](spark, LARGER)
    assert rows.filter("score < 0 or score > 1 or score is null").isEmpty()
    assert rows.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    held = rows.join(labels, "doc_id").filter("held_out")
    assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = queries.op10_language_id(spark, LARGER).join(docs, "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_prior_from_good_rows_alone(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    good = spark.read.parquet(f"{LARGER}/labels.parquet").filter("quality = 1")
    model = quality.fit(docs, good, per_class=500)
    assert 0.4 <= model.prior <= 0.99


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(before)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality classifier":
            right = [(i in after) == bool(labels[i]) for i in before if i in labels]
            assert sum(right) >= 0.9 * len(right)
        elif name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, c) in plain.components(sorted(before.items())).items() if i == c}
        elif name == "benchmark decontamination":
            assert set(after) == {i for i, t in before.items() if not plain.contamination(t, items)[4]}
        else:
            assert set(after) == set(before)
            for i, text in after.items():
                assert plain.secrets(text)[:3] == (0, 0, 0)
                assert text == before[i] or plain.secrets(before[i])[:3] != (0, 0, 0) or "[" in text
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()

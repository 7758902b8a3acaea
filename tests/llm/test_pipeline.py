"""The stages in order, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from postloom.llm import decontaminate

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        result = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(result.collect(), result.schema)
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} <= before.keys()
        if name == "language":
            assert {r.doc_id for r in docs.collect()} == {i for i, t in before.items() if t and any(map(str.isalpha, t))}
        if name == "decontamination":
            assert not decontaminate.report(docs, bench).filter("contaminated").count()
        if name == "secrets":
            assert {r.doc_id for r in docs.collect()} == before.keys()
    assert {r.doc_id for r in docs.collect()} == before.keys()


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 0 and rows.columns[0] == "doc_id"


def test_rows_without_ids_and_clashing_names(spark, corpus):
    """Rows without an id pass the stages by their texts alone; columns of the operators' names stay as they are."""
    extra = {c: F.lit("mine") for c in ("doc", "t1", "first", "n", "contamination", "ids", "score")}
    names = list(extra)
    docs = corpus.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        result = stage(spark, docs, FOLDER)
        assert result.columns == docs.columns
        docs = spark.createDataFrame(result.collect(), result.schema)
        assert 0 < docs.count() <= before, name
    kept = docs.collect()
    assert {tuple(r[c] for c in names) for r in kept} == {("mine",) * len(names)}
    # One row has no id; it is kept, as no other text is near it.
    assert [r.doc_id for r in kept].count(None) == 1
    assert len({r.text for r in kept}) == len(kept)


def test_nothing_to_do(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, FOLDER)
        assert result.count() == 0
        docs = result if "text" in result.columns else docs

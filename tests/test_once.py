import pytest
from pyspark.sql import functions as F

from postloom.operators import features as FE
from postloom.operators.once import once_per_text


@pytest.fixture(scope="module")
def copies(spark):
    rows = [(i, "a hot text") for i in range(400)] + [(400 + i, f"text {i % 150}") for i in range(300)]
    rows += [(900, None), (901, None), (902, ""), (902, ""), (None, "text 3"), (None, None)]
    return spark.createDataFrame(rows, "id bigint, clean_text string").withColumn("n", F.lit(1)).repartition(5)


@pytest.mark.parametrize("hot_share", [0.0, 0.01, 1.0])
def test_each_text_is_worked_on_once(spark, copies, hot_share):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def run(texts):
            calls.add(len(texts))
            return FE.trigram_model(8)()(texts)

        return run

    whole = FE.encode(copies, FE.model_encoder(FE.trigram_model(8)))
    once = once_per_text(copies, "clean_text", lambda d: FE.encode(d, FE.model_encoder(load)), hot_share)
    assert once.columns == whole.columns
    key = lambda r: (r.id is None, r.id, r.clean_text is None, r.clean_text or "")
    assert sorted(map(key, once.collect())) == sorted(map(key, whole.collect()))
    want = {r.clean_text: r.embedding for r in whole.collect()}
    assert all(r.embedding == want[r.clean_text] for r in once.collect())
    assert calls.value == 1 + 150 + 2  # the hot text, the others, null and the empty one; never again


def test_clashing_and_empty(copies):
    with pytest.raises(ValueError):
        once_per_text(copies, "clean_text", lambda d: d.withColumn("N", F.lit(2)))
    assert once_per_text(copies.limit(0), "clean_text", lambda d: d.withColumn("x", F.lit(2))).count() == 0


def test_frequent_texts_are_not_shuffled(copies):
    once = once_per_text(copies, "clean_text", lambda d: d.withColumn("x", F.length("clean_text")))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "strategy=merge" in plan

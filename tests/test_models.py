import random

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postloom.operators import features as FE
from postloom.operators import models as ML
from postloom.plans import train as TR
from postloom.sources.delimited import read_metrics

WORDS = {"positivo": ["gol", "feliz", "gana"], "negativo": ["robo", "mal", "asco"], "neutro": ["hoy", "partido", "sede"]}


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        label = rng.choice(list(WORDS))
        words = rng.choices(WORDS[label], k=4) + rng.choices(["el", "la", "que"], k=2)
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "id int, clean_text string, label_sentiment string").coalesce(2).cache()


def test_vectors_equal_long_form(spark, posts):
    model = FE.fit_tfidf(posts, max_features=6)
    words = model.stages[0].vocabulary
    vectors = FE.with_tfidf(posts, model).select("id", vector_to_array("features").alias("v")).collect()
    long = {(r["id"], r["term"]): r["weight"] for r in FE.tfidf(posts, "id", max_features=6).collect()}
    dense = {(r["id"], w): x for r in vectors for w, x in zip(words, r["v"]) if x}
    assert dense.keys() == long.keys()
    assert all(dense[k] == pytest.approx(long[k], abs=1e-12) for k in long)


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa"), (3, "x")], "id int, clean_text string")
    rows = {(r["id"], r["term"]): r["weight"] for r in FE.tfidf(df, "id").collect()}
    # idf: aa ln(4/3)+1, bb ln(4/2)+1
    a, b = 1.2876820724517808, 1.6931471805599454
    norm = (a * a + b * b) ** 0.5
    assert rows[2, "aa"] == pytest.approx(1)
    assert rows[1, "aa"] == pytest.approx(a / norm) and rows[1, "bb"] == pytest.approx(b / norm)
    assert (3, "x") not in rows


def test_tfidf_vectors_need_no_shuffle(spark, posts):
    model = FE.fit_tfidf(posts, max_features=6)
    plan = FE.with_tfidf(posts, model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_fit_on_train_leaves_test_words_out(spark):
    train = spark.createDataFrame([(1, "aa bb")], "id int, clean_text string")
    test = spark.createDataFrame([(2, "aa cc")], "id int, clean_text string")
    assert {r["term"] for r in FE.tfidf(test, "id", fit_on=train).collect()} == {"aa"}


def test_vocabulary_limit(spark, posts, monkeypatch):
    monkeypatch.setattr(FE, "FEW_FEATURES", 0)
    assert FE.fit_tfidf(posts).stages
    monkeypatch.setattr(FE, "MAX_VOCABULARY_BYTES", 1)
    with pytest.raises(ValueError):
        FE.fit_tfidf(posts)


def test_documents_that_share_a_key_stay_apart(spark):
    rows = [("h", "uno dos dos"), ("h", "dos tres"), (None, "tres"), (None, "")]
    df = spark.createDataFrame(rows, "k string, clean_text string")
    counts = sorted(tuple(r)[1:] for r in FE.term_counts(df, "k").collect())
    assert counts == [("dos", 1), ("dos", 2), ("tres", 1), ("tres", 1), ("uno", 1)]
    assert FE.tfidf(df, "k").count() == 5
    plan = FE.term_counts(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_unknown_labels_teach_nothing(spark, posts):
    rows = FE.with_tfidf(posts, FE.fit_tfidf(posts)).select("label_sentiment", "features")
    odd = rows.limit(9).withColumn("label_sentiment", F.lit("other"))
    nulls = rows.limit(9).withColumn("label_sentiment", F.lit(None).cast("string"))
    more = ML.train(rows.unionByName(odd).unionByName(nulls), "lr").stages[0].coefficientMatrix
    assert abs(more.toArray() - ML.train(rows, "lr").stages[0].coefficientMatrix.toArray()).max() < 1e-3


def test_saved_models_score_raw_texts(spark, posts, tmp_path):
    metrics = TR.compare_tfidf(posts, "id", folder=str(tmp_path))
    found = ML.predict(ML.load_model(str(tmp_path / "NaiveBayes")), posts)
    right = found.filter("predicted = label_sentiment").count()
    assert right > 0.9 * posts.count()
    stored = read_metrics(spark, str(tmp_path / "metrics"))
    assert sorted(r["model"] for r in stored.collect()) == sorted(r["model"] for r in metrics.collect())
    lines = {r[0] for r in spark.read.text(str(tmp_path / "experiment_log")).collect()}
    assert "Features: 5000" in lines


@pytest.mark.parametrize("kind", ML.KINDS)
def test_models_learn(spark, posts, kind, tmp_path):
    rows = FE.with_tfidf(posts, FE.fit_tfidf(posts)).cache()
    model = ML.train(rows, kind)
    ML.save_model(model, str(tmp_path / kind))
    found = ML.predict(ML.load_model(str(tmp_path / kind)), rows)
    assert ML.weighted_prf(found, "label_sentiment", "predicted").first()["f1"] > 0.95


def test_fits_take_the_tasks_their_size_asks_for(spark, posts, tmp_path):
    FE.with_tfidf(posts, FE.fit_tfidf(posts)).select("features").repartition(6).write.parquet(str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    one, n = ML.in_fit_tasks(rows)
    assert one.rdd.getNumPartitions() == 1 and n == one.count() == posts.count()
    many, _ = ML.in_fit_tasks(rows, task_bytes=100)
    assert many.rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    assert ML.in_fit_tasks(rows.limit(0))[1] == 0


def test_prf_equals_spark(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(200)]
    df = spark.createDataFrame(rows, "y string, p string")
    ours = ML.weighted_prf(df, "y", "p").first()
    labels = spark.createDataFrame([(x,) for x in "abcd"], "y string")
    index = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(labels)
    indexed = index.transform(df)
    both = index.setInputCol("p").setOutputCol("prediction").transform(indexed)
    for ours_name, name in (("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "weightedFMeasure")):
        theirs = MulticlassClassificationEvaluator(metricName=name).evaluate(both)
        assert ours[ours_name] == pytest.approx(theirs, abs=1e-9)


def test_compare(spark, posts, tmp_path):
    tfidf = TR.compare_tfidf(posts, "id", fit_on="train", folder=str(tmp_path))
    assert [r["model"] for r in tfidf.collect()] == ["NaiveBayes", "LogisticRegression", "SVM"]
    assert (tmp_path / "SVM").is_dir()
    encoded = TR.compare_encoders(posts, {"A": FE.hashing_encoder(32)}, "id")
    assert [r["model"] for r in encoded.collect()] == ["LogisticRegression_A", "SVM_A"]
    assert all(0 <= r["f1"] <= 1 for r in encoded.collect())


def test_encoders_give_unit_vectors(spark, posts):
    for encoder in (FE.hashing_encoder(16), FE.model_encoder(FE.trigram_model(16))):
        rows = FE.encode(posts, encoder)
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        assert {r[0] for r in rows.select(F.size("embedding")).distinct().collect()} == {16}
        assert rows.filter(F.abs(norm - 1) > 1e-5).count() == 0


def test_trigram_vectors_of_any_letters():
    texts = ["", "a", "año 🔥🔥 año", "\0\U0010ffff\uffff", "None", "x" * 3000]
    lists = [[f"  {t} "[i : i + 3].encode() for i in range(len(t) + 1)] for t in texts]
    assert (FE.trigram_model(16)()(np.array(texts, object)) == FE.hashed_rows(lists, 16)).all()
    assert FE.trigram_model(16)()(np.array([], object)).shape == (0, 16)


def test_each_distinct_trigram_is_spelled_once(monkeypatch):
    seen = []
    monkeypatch.setattr(FE, "signed_rows", lambda distinct, which, lengths, size: seen.extend(distinct))
    FE.trigram_model(16)()(np.array(["aaaa", "aaab"], object))
    assert sorted(seen) == [b"  a", b" aa", b"aa ", b"aaa", b"aab", b"ab "]

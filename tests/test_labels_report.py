import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.operators import agreement as A
from postloom.operators import label as LB
from postloom.operators import report as RP


def pairs(spark, counts):
    rows = [(a, b) for (a, b), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_kappa(spark):
    known = {("a", "a"): 20, ("a", "b"): 5, ("b", "a"): 10, ("b", "b"): 15}
    assert tuple(A.cohen_kappa(pairs(spark, known), "a", "b").first()) == (0.4, 50)
    equal = {("x", "x"): 3, ("y", "y"): 2, (None, "x"): 4}
    assert tuple(A.cohen_kappa(pairs(spark, equal), "a", "b").first()) == (1.0, 5)
    assert A.cohen_kappa(pairs(spark, {("x", "x"): 3}), "a", "b").first()["kappa"] is None


def test_kappa_report(spark):
    known = {("a", "a"): 20, ("a", "b"): 5, ("b", "a"): 10, ("b", "b"): 15}
    row = A.kappa_report(pairs(spark, known), "a", "b", note=True).first()
    assert tuple(row) == (0.4, "moderado (reportar y justificar)", 50, 42)
    df = spark.createDataFrame([(k,) for k in (0.81, 0.8, 0.79, 0.6, 0.4, 0.39, None)], "k double")
    levels = [r[0] for r in df.select(A.interpret_kappa(F.col("k"))).collect()]
    assert levels == [
        "casi perfecto", "casi perfecto", "sustancial", "sustancial", "moderado", "pobre", None,
    ]


def test_agreement_matrix_is_dense(spark):
    df = pairs(spark, {("positivo", "positivo"): 2, ("positivo", "neutro"): 1, ("x", "neutro"): 1})
    rows = {(r["a"], r["b"]): (r["count"], r["pct"]) for r in A.agreement_matrix(df, "a", "b").collect()}
    assert len(rows) == 9
    assert rows["positivo", "positivo"] == (2, 66.7)
    assert rows["neutro", "neutro"] == (0, None)


def test_map_and_argmax(spark):
    df = spark.createDataFrame([("POS",), ("odd",), (None,)], "x string")
    got = [r[0] for r in df.select(LB.map_labels(F.col("x"), LB.SHORT_NAMES)).collect()]
    assert got == ["positivo", "neutro", "neutro"]
    scores = F.create_map(F.lit("a"), F.lit(0.25), F.lit("b"), F.lit(0.5625))
    assert tuple(spark.range(1).select(LB.argmax_label(scores).alias("r")).first()["r"]) == ("b", 0.562)


TEXTS = ["feliz victoria amor", "robo y asco", "nada", None, "feliz enojado"]


def posts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, clean_text string")


def test_strategies(spark):
    both = LB.label_posts(posts(spark), "BOTH").orderBy("id").collect()
    assert [r["label_sentiment"] for r in both] == ["positivo", "negativo", "neutro", "neutro", "neutro"]
    assert [r["label_secondary"] for r in both] == ["positivo", "negativo", "neutro", "neutro", "neutro"]
    assert both[2]["label_confidence"] == 0.5
    second = LB.label_posts(posts(spark), "secondary")
    assert "label_secondary" not in second.columns and "label_confidence" in second.columns
    assert LB.label_posts(posts(spark), "none").columns == ["id", "clean_text"]
    with pytest.raises(ValueError):
        LB.label_posts(posts(spark), "third")


def test_model_scorer(spark):
    def load():
        return lambda texts: np.array([[0.1, 0.7, 0.2] if "robo" in t else [0.2, 0.1, 0.7] for t in texts])

    rows = LB.annotate(posts(spark), LB.Annotator(LB.model_scorer(load))).orderBy("id").collect()
    assert [r["label_sentiment"] for r in rows] == ["neutro", "negativo", "neutro", "neutro", "neutro"]
    assert rows[1]["label_confidence"] == 0.7


@pytest.mark.parametrize("options", [{}, {"row_bytes": 0}, {"row_bytes": 0, "max_bytes": 0}])
def test_lexicon_table_equals_fixed_lexicon(spark, options):
    words = {**LB.OPINION_WORDS, **LB.MOOD_WORDS}
    table = spark.createDataFrame(list(words.items()), "word string, weight int")
    twice = table.unionByName(table.withColumn("weight", F.lit(9)))  # the smallest weight counts
    rows = posts(spark).unionByName(posts(spark))  # repeated rows each get their sums
    hits = LB.with_table_hits(rows, twice, **options).orderBy("id").collect()
    assert [(r["pos"], r["neg"]) for r in hits[::2]] == [(5, 0), (0, 4), (0, 0), (0, 0), (1, 2)]
    assert hits[::2] == hits[1::2]


def test_fixed_lexicon_needs_no_shuffle(spark):
    plan = LB.label_posts(posts(spark), "both")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_distribution(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label_sentiment string")
    rows = [tuple(r) for r in LB.label_distribution(df).collect()]
    assert rows == [("a", 3, 75.0, "█" * 37), ("b", 1, 25.0, "█" * 12)]


def test_validation_sample(spark):
    df = spark.range(100).select(
        F.col("id").alias("tweet_id_hashed"),
        F.lit("t").alias("clean_text"),
        F.when(F.col("id") < 90, "positivo").otherwise("neutro").alias("label_sentiment"),
        F.lit(0.5).alias("label_confidence"),
    )
    sheet = LB.validation_sample(df, 60)
    assert sheet.columns == ["tweet_id_hashed", "clean_text", "label_sentiment", "label_confidence", "label_manual"]
    counts = {r["label_sentiment"]: r["count"] for r in sheet.groupBy("label_sentiment").count().collect()}
    assert counts == {"positivo": 20, "neutro": 10}
    assert {r["label_manual"] for r in sheet.collect()} == {""}


def test_kpis(spark):
    df = spark.createDataFrame(
        [("positivo", "positivo", 0.5), ("negativo", "neutro", 0.7)],
        "label_sentiment string, label_secondary string, label_confidence double",
    )
    row = RP.kpis(df).first()
    assert (row["total"], row["positivo"], row["neutro_pct"], row["agreement_pct"]) == (2, 1, 0.0, 50.0)
    assert row["confidence_pct"] == pytest.approx(60)


@pytest.mark.parametrize("low, high, step", [(0, 1, 0.05), (0.34, 1, 0.05), (0, 100, 5), (0.5, 0.5, 0.05)])
def test_nice_step(low, high, step):
    assert RP.nice_step(low, high) == pytest.approx(step) or low == high


def test_histogram_edges_stay_in_their_bin(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(101)], "c double")
    rows = {r["bin_start"]: r["n"] for r in RP.confidence_histogram(df, ["c"]).collect()}
    assert rows == {**{round(i * 0.05, 2): 5 for i in range(20)}, 1.0: 1}


def test_activity_buckets(spark):
    at = [datetime.datetime(2022, 12, 11, 18, m) for m in (0, 29, 30)]
    df = spark.createDataFrame([(t, "positivo") for t in at], "created_at timestamp_ntz, label_sentiment string")
    rows = {r["created_at"].minute: r["count"] for r in RP.activity(df).collect()}
    assert rows == {0: 2, 30: 1}


def test_top_words(spark):
    text = "goles gol gol de 2022 mess's mess Mess as a1 pass"
    df = spark.createDataFrame([(text, "negativo"), ("gol", "positivo")], "clean_text string, label_sentiment string")
    folded = {r["word"]: r["n"] for r in RP.top_words(df, "negativo").collect()}
    assert folded == {"gol": 2, "goles": 1, "mess": 3, "as": 1, "a1": 1, "pass": 1}
    plural = spark.createDataFrame([("gato gatos gatos", "negativo")], "clean_text string, label_sentiment string")
    assert [tuple(r) for r in RP.top_words(plural, "negativo").collect()] == [("gato", 3)]


def test_top_posts(spark):
    df = spark.createDataFrame(
        [(1, "x" * 300, 5, 0.876), (2, "b", 5, 0.5), (3, "c", None, 0.1), (4, "d", 9, 0.25)],
        "id int, full_text string, retweet_count int, label_confidence double",
    ).withColumn("label_sentiment", F.lit("negativo"))
    rows = RP.top_posts(df, "negativo", k=2).collect()
    assert [r["id"] for r in rows] == [4, 1]
    assert len(rows[1]["full_text"]) == 223 and rows[1]["confidence_pct"] == "88%"


def test_metrics_tables(spark):
    schema = "model string, precision double, recall double, f1 double"
    base = spark.createDataFrame([("NB", 0.5, 0.5, 0.5)], schema)
    embedded = spark.createDataFrame([("LR_A", 0.6, 0.6, 0.61239)], schema)
    rows = RP.format_metrics(RP.compare_metrics(base, embedded)).collect()
    assert [(r["model"], r["f1"], r["tipo"]) for r in rows] == [
        ("LR_A", "0.612", "Embeddings"), ("NB", "0.500", "TF-IDF"),
    ]


def test_explore(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "created_at int, full_text string")
    assert [r["full_text"] for r in RP.explore(df, ["created_at"], 2).collect()] == ["a", "b"]
    assert RP.explore(df, ["created_at"], None).count() == 3


def test_listed_tokens_are_those_of_all_tokens(spark):
    # F7 (lb5_kappa_of_annotators), F10 (lb4_label_secondary): each annotator listed every token of a text.
    rng = random.Random(3)
    listed = ["no", "non", "n_o", "no'a", "été", "7", "a-b", "", "'", "𝒜", "no no"]
    pieces = [*listed, " ", " ", "'", "''", "-", "_", "x", ".", "\n", "é"]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(4)
    want = F.filter(X.tokens(F.col("t")), lambda w: w.isin(*listed))
    rows = df.select("t", LB.listed_tokens(F.col("t"), listed).alias("got"), want.alias("want"))
    assert rows.filter("size(want) > 1").count() > 200
    assert [tuple(r) for r in rows.filter("NOT got <=> want").take(5)] == []
    none = df.select(LB.listed_tokens(F.col("t"), ["a-b"]).alias("got"), F.col("t").isNull().alias("gone"))
    assert not none.filter("gone != isnull(got) OR size(got) > 0").count()

import datetime

import pytest
from pyspark.sql import functions as F

from postloom.config import SENSITIVE
from postloom.operators import curate as C
from postloom.operators.profile import assert_absent
from postloom.plans.curation import curate

NAN_HASH = "9b2d5b4678781e53038e91ea5324530a03f27dc1d0e5f6c9bc9d493a23be9de0"


def test_dedup_comes_before_retweet_filter(spark):
    df = spark.createDataFrame(
        [(1, "a", True), (2, "a", False), (3, "b", False), (4, None, False), (5, None, True)],
        "id int, full_text string, retweeted boolean",
    )
    kept = C.drop_retweets(C.dedup_keep_first(df, "full_text", ["id"]))
    assert sorted(r["id"] for r in kept.collect()) == [3, 4]
    assert kept.columns == df.columns


def test_dedup_survives_hot_key_and_repartition(spark):
    rows = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t")
    )
    expected = {(r["id"], r["t"]) for r in rows.collect() if r["t"] != "hot"} | {(0, "hot")}
    for n in (1, 7):
        got = C.dedup_keep_first(rows.repartition(n), "t", ["id"]).collect()
        assert {(r["id"], r["t"]) for r in got} == expected


def test_dedup_combines_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id", "cast(id % 2 as string) as t")
    plan = C.dedup_keep_first(df, "t", ["id"])._jdf.queryExecution().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_hashed_id_of_null(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("a", "b")], "full_text string, created_at string")
    ids = [r["tweet_id_hashed"] for r in C.with_hashed_id(df).collect()]
    assert ids[0] == ids[1] == NAN_HASH
    assert ids[2] == "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"


def test_sparse_columns_strictly_above(spark):
    df = spark.range(20).select(
        "id",
        F.when(F.col("id") == 0, 1).alias("at_limit"),
        F.lit(None).cast("int").alias("above"),
    )
    assert C.sparse_columns(df, 0.95) == ["above"]


def test_curate(spark):
    rows = [
        (1, "ana", "x", "es", False, "d1"), (2, "bob", "x", "es", False, "d2"),
        (3, "eva", "y", "en", False, "d3"), (4, "leo", "z", "es", True, "d4"),
        (5, "mia", "w", "es", None, "d5"),
    ]
    df = spark.createDataFrame(
        rows, "id int, name string, full_text string, lang string, retweeted boolean, created_at string"
    ).withColumn("empty", F.lit(None).cast("string"))
    out = curate(df, ["id"])
    assert out.columns == ["full_text", "lang", "retweeted", "created_at", "tweet_id_hashed"]
    assert [(r["full_text"], r["created_at"]) for r in out.collect()] == [("x", "d1")]
    assert not any(r["present"] for r in assert_absent(out, SENSITIVE).collect())


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Sun Dec 11 18:00:00 +0000 2022", (2022, 12, 11, 18)),
        ("Sun Dec 11 18:00:00 +0200 2022", (2022, 12, 11, 16)),
        ("1670781600000", (2022, 12, 11, 18)),
        ("2022-12-11 18:00:00", (2022, 12, 11, 18)),
        ("2022-12-11T18:00:00Z", (2022, 12, 11, 18)),
        ("2022-12-11T18:00:00-01:00", (2022, 12, 11, 19)),
        ("2022-12-11", (2022, 12, 11, 0)),
        ("2022-13-41", None),
        ("soon", None),
        (None, None),
    ],
)
def test_timestamps(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "created_at string")
    got = [r["created_at"] for r in C.with_timestamp(df).collect()]
    assert got == ([] if expected is None else [datetime.datetime(*expected)])


def test_filter_and_select(spark):
    df = spark.createDataFrame(
        [("positivo", datetime.datetime(2022, 12, 11, h)) for h in (5, 6, 9, 10)] + [(None, None)],
        "label_sentiment string, created_at timestamp_ntz",
    )
    assert C.filter_posts(df, ["positivo"], 6, 9).count() == 2
    assert tuple(C.hour_bounds(df).first()) == (5, 10)
    assert C.select_existing(df, ["x", "created_at"]).columns == ["created_at"]

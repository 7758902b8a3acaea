import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.operators import bounded as B
from postloom.operators import profile as PR
from postloom.operators import sample as SA


@pytest.mark.parametrize("rows_held", [3, 100_000])
def test_quantiles_equal_numpy(spark, monkeypatch, rows_held):
    monkeypatch.setattr(B, "BRACKET_ROWS", rows_held)
    monkeypatch.setattr(B, "SKETCH", 40)
    rng = np.random.default_rng(1)
    # A third of all rows share one value.
    values = np.where(rng.random(5000) < 0.33, 7.0, rng.normal(size=5000))
    frame = pd.DataFrame({"x": values, "one": 3, "few": rng.integers(0, 3, 5000)})
    df = spark.createDataFrame(frame)
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    rows = B.exact_quantiles(df, ["x", "one", "few"], probabilities).collect()
    got = {r["column"]: r for r in rows}
    for name in frame:
        want = np.quantile(frame[name], probabilities)
        assert np.allclose([got[name][i + 1] for i in range(len(probabilities))], want)


def test_describe_equals_pandas(spark):
    frame = pd.DataFrame(
        {
            "n": [1.0, 2.0, None, 4.0, 10.0],
            "w": ["b", "a", "b", None, "a"],
            "t": pd.to_datetime(["2022-12-11", "2022-12-12", "2022-12-14", None, "2022-12-20"]),
        }
    )
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "n double, w string, t timestamp_ntz")
    rows = {r["column"]: r for r in PR.describe_all(df).collect()}
    want = frame["n"].describe()
    got = rows["n"]
    assert [got["count"], got["mean"], got["min"], got["p25"], got["p50"], got["p75"], got["max"]] == [
        want[k] for k in ("count", "mean", "min", "25%", "50%", "75%", "max")
    ]
    assert got["std"] == pytest.approx(want["std"])
    assert (rows["w"]["count"], rows["w"]["unique"], rows["w"]["top"], rows["w"]["freq"]) == (4, 2, "a", 2)
    assert rows["t"]["p50"] == frame["t"].dropna().astype("int64").median() / 1e9


def test_describe_empty_column(spark):
    df = spark.createDataFrame([(None, None)], "n double, w string")
    rows = {r["column"]: r for r in PR.describe_all(df).collect()}
    assert rows["n"]["count"] == 0 and rows["n"]["p50"] is None
    assert rows["w"]["count"] == 0 and rows["w"]["top"] is None


def test_histogram_equals_numpy(spark):
    values = [1, 1, 2, 5, 9, 31, 31, 16]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    rows = PR.equal_width_histogram(df, "x", 10).orderBy("bin").collect()
    counts, edges = np.histogram(values, 10)
    assert [r["n"] for r in rows] == counts.tolist()
    assert np.allclose([r["left_edge"] for r in rows], edges[:-1])
    same = spark.createDataFrame([(4,), (4,)], "x int")
    assert [r["n"] for r in PR.equal_width_histogram(same, "x", 4).orderBy("bin").collect()] == [
        0, 0, 2, 0,
    ]


def test_nulls_and_patterns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "x")], "a int, b string")
    assert {r["column"]: r["nulls"] for r in PR.null_counts(df).collect()} == {"a": 1, "b": 2}
    assert {r["pattern"]: r["n"] for r in PR.null_patterns(df).collect()} == {"01": 1, "11": 1, "00": 1}
    assert [tuple(r) for r in PR.value_counts(df, "a").collect()] == [(1, 1), (2, 1)]
    assert PR.mean_length(df, "b").first()[0] == 3.0


@pytest.mark.parametrize("edge", [0, 100_000])
def test_sample_sizes_and_stability(spark, monkeypatch, edge):
    monkeypatch.setattr(B, "EDGE_ROWS", edge)
    df = spark.range(5000).withColumn("k", F.concat(F.lit("c"), (F.col("id") % 3 == 0).cast("int")))
    first = {r["id"] for r in SA.sample_n(df.repartition(3), 100, 42, "id").collect()}
    again = {r["id"] for r in SA.sample_n(df.repartition(11), 100, 42, "id").collect()}
    assert first == again and len(first) == 100
    assert first == {r[0] for r in df.orderBy(F.md5(F.concat(F.lit("42:"), "id"))).limit(100).collect()}
    assert SA.sample_n(df, 9999, 42, "id").count() == 5000
    assert SA.sample_n(df, 0, 42, "id").count() == 0


@pytest.mark.parametrize("edge", [0, 100_000])
@pytest.mark.parametrize("n", [1, 900, 1500, 2999])
def test_samples_keep_null_and_repeated_keys(spark, monkeypatch, n, edge):
    monkeypatch.setattr(B, "EDGE_ROWS", edge)
    key = F.when(F.col("id") % 3 != 0, F.col("id") % 50)
    rows = spark.range(3000).select("id", key.alias("k"), (F.col("id") % 2).cast("string").alias("s"))
    assert SA.sample_n(rows, n, 42, "k").count() == n
    same = rows.select(F.lit(1).alias("k"))  # rows that nothing tells apart
    assert SA.sample_n(same, n, 42, "k").count() == n
    got = SA.stratified_sample(rows, 2 * n, 42, "k", "s", ("0", "1"))
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {s: min(n, 1500) for s in "01"}


def test_strata(spark):
    labels = ["a"] * 300 + ["b"] * 20 + ["c"] * 80 + [None] * 5 + ["other"] * 9
    df = spark.createDataFrame([(i, k) for i, k in enumerate(labels)], "id int, k string")
    got = SA.stratified_sample(df, 150, 42, "id", "k", ("a", "b", "c"))
    sizes = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
    assert sizes == {"a": 50, "b": 20, "c": 50}


def test_samples_shuffle_no_rows(spark):
    df = spark.range(100).withColumn("k", (F.col("id") % 2).cast("string")).withColumn("wide", F.lit("x"))
    plan = SA.stratified_sample(df, 30, 42, "id", "k", ("0", "1", "2"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in text and text.count("Exchange") <= 1


def test_sample_too_large(spark):
    with pytest.raises(ValueError):
        SA.sample_n(spark.range(5), 6, 42, "id", check=True)


def test_split_is_a_partition(spark):
    df = spark.range(4000)
    train, test = SA.hash_split(df, "id")
    assert train.count() + test.count() == 4000 and train.intersect(test).count() == 0
    assert 700 < test.count() < 900
    nulls = df.select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"))
    train, test = SA.hash_split(nulls, "id")
    assert train.count() + test.count() == 4000


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_lookup_join_with_hot_key(spark, max_bytes):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise("x"))
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    rows = B.lookup_join(df, table, "k", max_bytes=max_bytes)
    assert rows.count() == 3000 and rows.filter("v = 1").count() == 1000

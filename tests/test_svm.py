"""Squared-hinge planes against a Newton solution on dense arrays."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postloom.operators import models as ML
from postloom.operators import svm


def newton(x, side, cost=1.0):
    """The plane of one class: each step solves the quadratic of the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def loss(w):
        return 0.5 * w @ w + cost * (np.maximum(0, 1 - side * (x @ w)) ** 2).sum()

    for _ in range(200):
        inside = side * (x @ w) < 1
        slope = w - 2 * cost * x[inside].T @ (side[inside] - x[inside] @ w)
        if np.linalg.norm(slope) < 1e-11:
            break
        way = np.linalg.solve(np.eye(len(w)) + 2 * cost * x[inside].T @ x[inside], slope)
        step = 1.0
        while loss(w - step * way) > loss(w) - 1e-8 * step * (slope @ way) and step > 1e-10:
            step /= 2
        w = w - step * way
    return w


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * (rng.random((300, 12)) < 0.5)
    label = (x[:, :3] + rng.normal(scale=0.7, size=(300, 3))).argmax(axis=1)
    return x, label


@pytest.fixture(scope="module")
def rows(spark, data):
    x, label = data
    vectors = []
    for i, (v, k) in enumerate(zip(x, label)):
        at = np.flatnonzero(v)
        kept = Vectors.dense(v) if i % 3 else Vectors.sparse(12, at.tolist(), v[at].tolist())
        vectors.append((i, "abc"[k], kept))
    return spark.createDataFrame(vectors, ["id", "label", "features"]).repartition(4).cache()


def test_scores_equal_the_optimum(rows, data):
    x, label = data
    model = ML.train(rows, "svm", "label", classes="abc", tol=1e-6)
    want = np.stack([np.hstack([x, np.ones((300, 1))]) @ newton(x, np.where(label == k, 1.0, -1.0)) for k in range(3)], axis=1)
    got = model.transform(rows).select("id", "rawPrediction", "predicted").collect()
    assert len(got) == 300
    for r in got:
        assert r.rawPrediction == pytest.approx(want[r.id].tolist(), abs=1e-4)
        assert r.predicted == "abc"[int(np.argmax(want[r.id]))]


def test_saved_planes_predict_the_same(rows, tmp_path):
    model = ML.train(rows, "svm", "label", classes="abc")
    ML.save_model(model, str(tmp_path / "model"))
    again = ML.load_model(str(tmp_path / "model"))
    assert isinstance(again, PipelineModel) and isinstance(again.stages[0], svm.PlanesModel)
    before = {r.id: r.predicted for r in ML.predict(model, rows).collect()}
    assert {r.id: r.predicted for r in ML.predict(again, rows).collect()} == before


def test_loss_does_not_depend_on_the_tasks(rows):
    plain = rows.select(F.lit(1).alias("label"), F.unwrap_udt("features").alias("x"))
    planes = np.random.default_rng(2).normal(size=(3, 13))
    one, many = (svm.loss_and_slope(plain.repartition(n), planes, 1.0) for n in (1, 7))
    assert np.allclose(one[0], many[0]) and np.allclose(one[1], many[1])


def test_no_rows_and_unknown_labels(spark, rows):
    model = ML.train(rows.filter("id < 0"), "svm", "label", classes="abc")
    assert {r.predicted for r in ML.predict(model, rows).collect()} == {"a"}
    mixed = rows.unionByName(rows.limit(5).withColumn("label", F.lit(None).cast("string")))
    same = ML.train(mixed, "svm", "label", classes="abc", tol=1e-8).stages[0].getOrDefault("planes")
    assert np.allclose(same, ML.train(rows, "svm", "label", classes="abc", tol=1e-8).stages[0].getOrDefault("planes"), atol=1e-6)


def test_least_points_of_steep_valleys():
    scale = np.array([[1.0, 10.0, 1000.0, 1e5], [1, 1, 1, 1], [3, 0.1, 2, 50]])
    target = np.array([[3.0, -1.0, 0.5, 2.0], [0, 0, 0, 0], [1, 2, 3, 4]])
    passes = []

    def of(w):
        passes.append(1)
        return (scale * (w - target) ** 2).sum(axis=1), 2 * scale * (w - target)

    found = svm.minimise(of, np.zeros((3, 4)), 1e-9)
    assert np.abs(found - target).max() < 1e-8 and len(passes) < 100


def test_dense_vectors_are_multiplied_whole(spark, data):
    # F3 (ml6_compare_encoders): entries of dense vectors were listed and added up one by one.
    x, label = data
    frames = {
        "dense": [Vectors.dense(r) for r in x],
        "sparse": [Vectors.sparse(12, np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x],
    }
    frames["mixed"] = [frames["dense" if i % 3 else "sparse"][i] for i in range(len(x))]
    planes, found, whole = np.random.default_rng(1).normal(size=(3, 13)), {}, {}
    for kind, vectors in frames.items():
        df = spark.createDataFrame([(int(c), v) for c, v in zip(label, vectors, strict=True)], ["label", "x"])
        rows = df.select(F.col("label").cast("int").alias("label"), F.unwrap_udt("x").alias("x")).coalesce(1)
        column = rows.toArrow().column("x").combine_chunks()
        whole[kind] = svm.matrix(column, 12)
        narrow = svm.matrix(column, 5)
        assert narrow is None or narrow.shape == (len(x), 5)
        found[kind] = svm.loss_and_slope(rows, planes, 1.0)
        assert np.allclose(svm.margins(column, planes)[0], x @ planes[:, :-1].T + planes[:, -1])
        # Planes that know fewer features than the rows have, or more.
        assert np.allclose(svm.margins(column, planes[:, 7:])[0], x[:, :5] @ planes[:, 7:-1].T + planes[:, -1])
        wide = np.hstack([planes, planes])
        assert np.allclose(svm.margins(column, wide)[0], x @ wide[:, :12].T + wide[:, -1])
    assert np.array_equal(whole["dense"], x) and whole["sparse"] is None and whole["mixed"] is None
    for kind in ("sparse", "mixed"):
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(found["dense"], found[kind], strict=True))

"""Logistic regression against a Newton solution on dense arrays."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from postloom.operators import models as ML


def newton(x, label, k):
    """Softmax weights with a cost of one per row; intercepts are not penalised."""
    n, d = x.shape
    x = np.hstack([x, np.ones((n, 1))])
    w, hot = np.zeros((k, d + 1)), np.eye(k)[label]
    penalty = np.tile(np.append(np.ones(d), 1e-9), k)
    for _ in range(100):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = ((p - hot).T @ x).ravel() + penalty * w.ravel()
        if np.linalg.norm(slope) < 1e-9:
            break
        bend = np.zeros((k, d + 1, k, d + 1))
        for a in range(k):
            for b in range(k):
                share = p[:, a] * ((a == b) - p[:, b])
                bend[a, :, b, :] = (x * share[:, None]).T @ x
        w -= np.linalg.solve(bend.reshape(w.size, w.size) + np.diag(penalty), slope).reshape(w.shape)
    return p


def test_probabilities_equal_the_optimum(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 6))
    label = (x[:, :3] + rng.normal(scale=0.8, size=(200, 3))).argmax(axis=1)
    rows = [(i, "abc"[k], Vectors.dense(v)) for i, (v, k) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, ["id", "label", "features"]).repartition(3).cache()
    want = newton(x, label, 3)
    found = ML.train(df, "lr", "label", classes="abc", tol=1e-9).transform(df)
    for r in found.select("id", vector_to_array("probability").alias("p"), "predicted").collect():
        assert r.p == pytest.approx(want[r.id].tolist(), abs=1e-3)
        assert r.predicted == "abc"[int(np.argmax(want[r.id]))]

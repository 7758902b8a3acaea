import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from postloom.operators import models as ML
from postloom.sources import runlog


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


def test_a_repeated_run_leaves_one_log(spark, tmp_path):
    path, log = str(tmp_path / "log"), runlog.experiment_log(spark, {"Seed": 42, "Rows": 7})
    for _ in range(2):
        runlog.append_log(log, path, "run/1")
        runlog.append_log(runlog.experiment_log(spark, {"kappa": 0.5}), path, "run/1", "kappa")
    assert lines(spark, path) == ["Rows: 7", "Seed: 42", "kappa: 0.5"]
    broken = log.withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        runlog.append_log(broken, path, "run 2")
    assert lines(spark, path) == ["Rows: 7", "Seed: 42", "kappa: 0.5"]
    runlog.append_log(log, path, "run 2")
    assert lines(spark, path) == ["Rows: 7", "Rows: 7", "Seed: 42", "Seed: 42", "kappa: 0.5"]


def doubling(factor):
    return PipelineModel([SQLTransformer(statement=f"SELECT *, id * {factor} AS times FROM __THIS__")])


class Broken:
    """A model whose saving stops half-way."""

    def write(self):
        return self

    def save(self, path):
        doubling(0).stages[0].write().save(f"{path}/stages/0")
        raise OSError("lost")


def test_only_whole_models_are_seen(spark, tmp_path):
    folder, rows = str(tmp_path / "models"), spark.range(3, 4)
    times = lambda run: ML.committed_model(folder, run).transform(rows).first()["times"]
    with pytest.raises(ValueError):
        times("a b")
    with pytest.raises(OSError):
        ML.commit_model(Broken(), folder, "a b")
    with pytest.raises(ValueError):
        times("a b")
    ML.commit_model(doubling(2), folder, "a b")
    assert times("a b") == 6
    with pytest.raises(OSError):
        ML.commit_model(Broken(), folder, "a b")
    assert times("a b") == 6
    ML.commit_model(doubling(5), folder, "a b")
    assert times("a b") == 15
    with pytest.raises(ValueError):
        times("c")

"""Classifiers on a vector column, their predictions and their scores."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASSES
from ..session import shared_dir
from .svm import fit_planes

KINDS = ("nb", "lr", "svm")
NAMES = {"nb": "NaiveBayes", "lr": "LogisticRegression", "svm": "SVM"}
# Bytes of vectors that one task of a fit reads in every step; below that a step costs more to start than to run.
FIT_TASK_BYTES = 16 * 1024 * 1024


def known_labels(df: DataFrame, label: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """The rows whose label is one of the classes."""
    return df.filter(F.col(label).isin(*classes))


def in_fit_tasks(
    rows: DataFrame, features: str = "features", task_bytes: int = FIT_TASK_BYTES
) -> tuple[DataFrame, int]:
    """Stored rows in no more tasks than their measured size asks for, and their number.

    A fit runs a job per step. Small rows in one task need no shuffle to be added up; rows above
    ``task_bytes`` keep one task for each, so large fits stay spread.
    """
    vector = F.unwrap_udt(features)
    size = 16 + 8 * F.size(vector["values"]) + 4 * F.coalesce(F.size(vector["indices"]), F.lit(0))
    found = rows.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return rows.coalesce(max(1, -(-(found["bytes"] or 0) // task_bytes))), found["n"]


def train(
    df: DataFrame,
    kind: str,
    label: str = "label_sentiment",
    features: str = "features",
    classes: Sequence[str] = CLASSES,
    n_rows: int | None = None,
    tol: float = 1e-4,
) -> PipelineModel:
    """Fit naive Bayes (``nb``), logistic regression (``lr``) or a squared-hinge SVM (``svm``).

    Rows whose label is null or not among ``classes`` teach nothing and do not count. The penalty
    equals a cost of one per row; for ``lr`` it needs the row count: pass ``n_rows``, counted the same
    way, if known. Store the rows before, as every pass reads them.
    """
    if kind not in KINDS:
        raise ValueError(f"model {kind!r}; expected one of {KINDS}")
    index = StringIndexerModel.from_labels(
        list(classes), inputCol=label, outputCol="__label", handleInvalid="error"
    )
    known = known_labels(df.select(label, features), label, classes)
    if n_rows is None and kind == "lr":
        n_rows = known.count()
    rows = index.transform(known)
    columns = {"featuresCol": features, "labelCol": "__label"}
    if kind == "nb":
        fitted = NaiveBayes(modelType="multinomial", smoothing=1.0, **columns).fit(rows)
    elif kind == "lr":
        lr = LogisticRegression(
            maxIter=1000,
            tol=tol,
            elasticNetParam=0.0,
            regParam=1.0 / max(1, n_rows),
            standardization=False,
            **columns,
        )
        fitted = lr.fit(rows)
    else:
        fitted = fit_planes(rows, len(classes), "__label", features, tol=tol)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(classes))
    return PipelineModel([fitted, back])


def predict(model: Model, df: DataFrame) -> DataFrame:
    """Add the ``predicted`` label."""
    return model.transform(df).drop("rawPrediction", "probability", "prediction")


def weighted_prf(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """One row ``(precision, recall, f1)``, each averaged over the classes by support.

    Rows are counted once per pair of labels; the rest works on those few pairs.
    """
    return weighted_prf_by(df, y, predicted)


def weighted_prf_by(df: DataFrame, y: str, predicted: str, *by: str) -> DataFrame:
    """The scores of ``weighted_prf`` for each value of the ``by`` columns, in one pass."""
    pairs = df.groupBy(*by, F.col(y).alias("y"), F.col(predicted).alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = pairs.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("y").alias("label"),
                    F.col("n").alias("support"),
                    none.alias("given"),
                    hit.alias("hits"),
                ),
                F.struct(
                    F.col("p").alias("label"),
                    none.alias("support"),
                    F.col("n").alias("given"),
                    none.alias("hits"),
                ),
            )
        ),
    )
    by_class = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("given")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("given") + F.col("support")), zero)

    def average(score):
        return F.try_divide(F.sum(score * F.col("support")), F.sum("support"))

    return by_class.groupBy(*by).agg(
        average(precision).alias("precision"), average(recall).alias("recall"), average(f1).alias("f1")
    )


def compare_models(
    train_part: DataFrame,
    test_part: DataFrame,
    feature_sets: Mapping[str, Callable[[DataFrame], DataFrame]],
    kinds: Sequence[str] = KINDS,
    label: str = "label_sentiment",
    classes: Sequence[str] = CLASSES,
    on_fit: Callable[[str, PipelineModel], None] | None = None,
) -> DataFrame:
    """Fit every kind of model on every feature set: rows ``(model, precision, recall, f1)``.

    ``feature_sets`` maps a suffix to a function that adds the ``features`` column. Features are
    stored once in the shared folder, and all passes of all fits read them there. Rows without a
    known label are left out of both parts. ``on_fit`` may save each model.
    """
    spark, result = train_part.sparkSession, None
    for suffix, featurize in feature_sets.items():
        parts = []
        for part in (train_part, test_part):
            path = shared_dir(spark, "features")
            rows = featurize(known_labels(part, label, classes)).select(label, "features")
            rows.write.parquet(path)
            parts.append(spark.read.schema(rows.schema).parquet(path))
        fit_rows, test_rows = parts
        fit_rows, n_rows = in_fit_tasks(fit_rows)
        scores = []
        for kind in kinds:
            name = f"{NAMES[kind]}_{suffix}" if suffix else NAMES[kind]
            # Planes within 0.01 of the optimum: no score of a row of length one is further off.
            tol = 1e-2 if kind == "svm" else 1e-4
            model = train(fit_rows, kind, label, classes=classes, n_rows=n_rows, tol=tol)
            if on_fit is not None:
                on_fit(name, model)
            # One row per model comes to the driver.
            row = weighted_prf(predict(model, test_rows), label, "predicted").first()
            scores.append((name, row["precision"], row["recall"], row["f1"]))
        metrics = spark.createDataFrame(
            scores, "model string, precision double, recall double, f1 double"
        )
        result = metrics if result is None else result.unionByName(metrics)
    return result


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def commit_model(model: Model, folder: str, run: str) -> None:
    """Save the model of a run so that a reader sees a whole model or none.

    Each attempt saves to a folder of its own; a small table that names the attempt is written last.
    A repeated run replaces the name, so the run has one model; a failed attempt is never named.
    """
    spark = SparkSession.getActiveSession()
    base, attempt = f"{folder}/run={quote(run, safe='')}", f"attempt-{uuid.uuid4().hex}"
    model.write().save(f"{base}/{attempt}")
    named = spark.createDataFrame([(time.time_ns(), attempt)], "at bigint, attempt string").coalesce(1)
    named.write.mode("append").parquet(f"{base}/committed")


def committed_model(folder: str, run: str) -> PipelineModel:
    """The model that the run committed last; ``ValueError`` if it never did."""
    spark = SparkSession.getActiveSession()
    base = f"{folder}/run={quote(run, safe='')}"
    try:
        named = spark.read.schema("at bigint, attempt string").parquet(f"{base}/committed")
        last = named.agg(F.max_by("attempt", "at")).first()[0]
    except AnalysisException:  # no such folder
        last = None
    if last is None:
        raise ValueError(f"run {run!r} committed no model in {folder}")
    return load_model(f"{base}/{last}")

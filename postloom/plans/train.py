"""Processed corpus to trained models and their metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..config import CLASSES
from ..operators import features as FE
from ..operators import models as ML
from ..operators.sample import hash_split
from ..sources import delimited, runlog


def _saver(folder: str | None, before: Sequence = ()):
    """Saves each fitted model behind the stages that make its features."""
    if folder is None:
        return None
    return lambda name, model: ML.save_model(PipelineModel([*before, model]), f"{folder}/{name}")


def _recorded(metrics: DataFrame, folder: str | None, **entries: object) -> DataFrame:
    """Write the metrics as CSV and the settings of the run beside the models."""
    if folder is not None:
        delimited.write_table_csv(metrics.coalesce(1), f"{folder}/metrics")
        log = runlog.experiment_log(metrics.sparkSession, entries)
        runlog.append_log(log, f"{folder}/experiment_log")
    return metrics


def compare_tfidf(
    df: DataFrame,
    key: str = "tweet_id_hashed",
    text: str = "clean_text",
    label: str = "label_sentiment",
    classes: Sequence[str] = CLASSES,
    max_features: int = 5000,
    fit_on: str = "all",
    seed: int = 42,
    folder: str | None = None,
) -> DataFrame:
    """Naive Bayes, logistic regression and SVM on TF-IDF.

    With ``folder``, each model is saved with the stages that turn clean texts into its features, and
    the metrics and the settings of the run are written beside them.

    ``fit_on="all"`` learns the vocabulary from all rows, test rows included; ``"train"`` does not.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on={fit_on!r}; expected 'all' or 'train'")
    train_part, test_part = hash_split(df, key, seed=seed)
    model = FE.fit_tfidf(df if fit_on == "all" else train_part, text, max_features)
    metrics = ML.compare_models(
        train_part,
        test_part,
        {"": lambda part: FE.with_tfidf(part, model, text)},
        ("nb", "lr", "svm"),
        label,
        classes,
        _saver(folder, FE.tfidf_stages(model, text)),
    )
    return _recorded(metrics, folder, Features=max_features, Fitted_on=fit_on, Seed=seed)


def compare_encoders(
    df: DataFrame,
    encoders: Mapping[str, FE.Encoder] | None = None,
    key: str = "tweet_id_hashed",
    text: str = "clean_text",
    label: str = "label_sentiment",
    classes: Sequence[str] = CLASSES,
    seed: int = 42,
    folder: str | None = None,
) -> DataFrame:
    """Logistic regression and SVM on the vectors of each encoder."""
    encoders = encoders or {
        "A": FE.hashing_encoder(),
        "B": FE.model_encoder(FE.trigram_model()),
    }
    train_part, test_part = hash_split(df, key, seed=seed)

    def featurizer(encoder: FE.Encoder):
        return lambda part: FE.with_vector(FE.encode(part, encoder, text, "__vec"), "__vec")

    sets = {name: featurizer(encoder) for name, encoder in encoders.items()}
    metrics = ML.compare_models(
        train_part, test_part, sets, ("lr", "svm"), label, classes, _saver(folder)
    )
    return _recorded(metrics, folder, Encoders=", ".join(encoders), Seed=seed)

"""Canonical corpus to processed and labelled corpus."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PreprocessConfig
from ..operators import agreement, label, sample
from ..operators import text as TX
from ..session import shared_dir
from ..sources import corpus, delimited, runlog


@dataclass(frozen=True)
class Outputs:
    """Target folders of a run."""

    corpus: str
    sample: str
    validation: str
    log: str
    kappa: str | None = None


def human_agreement(
    posts: DataFrame, sheet: DataFrame, key: str = "tweet_id_hashed", label: str = "label_sentiment", seed: int = 42
) -> DataFrame:
    """Kappa of the automatic labels against a sheet that came back with ``label_manual`` filled in.

    Rows left empty do not count. Only the sheet's rows of the corpus are read.
    """
    filled = sheet.select(key, F.trim("label_manual").alias("label_manual")).filter("label_manual <> ''")
    both = posts.select(key, label).join(filled, key)
    return agreement.kappa_report(both, label, "label_manual", seed)


def preprocess(
    df: DataFrame,
    config: PreprocessConfig = PreprocessConfig(),
    lemmas: DataFrame | None = None,
    key: str = "tweet_id_hashed",
    annotators: Mapping[str, label.Annotator] | None = None,
) -> DataFrame:
    """Add clean text, tokens (or lemmas) and labels: one lazy plan."""
    out = TX.with_tokens(TX.with_clean_text(df, config))
    if config.lemmatize:
        if lemmas is None:
            raise ValueError("lemmatize needs a (form, lemma) table")
        out = TX.with_lemmas(out, lemmas)
    return label.label_posts(out, config.label_strategy, annotators)


def run(
    df: DataFrame,
    outputs: Outputs,
    config: PreprocessConfig = PreprocessConfig(),
    lemmas: DataFrame | None = None,
    key: str = "tweet_id_hashed",
    annotators: Mapping[str, label.Annotator] | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Store the processed corpus once as Parquet; the JSON Lines corpus, the log, the samples and the
    agreement come from the stored rows. Returns those. A run that is repeated under the same ``run_id``
    replaces its own log lines; without one, lines are appended."""
    spark = df.sparkSession
    path = shared_dir(spark, "processed")
    planned = preprocess(df, config, lemmas, key, annotators)
    planned.write.parquet(path)
    stored = spark.read.schema(planned.schema).parquet(path)
    corpus.write_corpus(stored, outputs.corpus)
    runlog.append_log(runlog.run_log(stored, config), outputs.log, run_id, "run")
    drawn = sample.sample_n(stored, config.sample_size, config.seed, key)
    delimited.write_table_csv(drawn, outputs.sample)
    if config.label_strategy.lower() != "none":
        sheet = label.validation_sample(stored, config.validation_size, config.seed, key)
        delimited.write_table_csv(sheet, outputs.validation)
    if config.label_strategy.lower() == "both":
        report = agreement.kappa_report(
            stored, "label_sentiment", "label_secondary", config.seed, note=True
        )
        runlog.append_log(runlog.kappa_log(report), outputs.log, run_id, "kappa")
        if outputs.kappa is not None:
            delimited.write_table_csv(report, outputs.kappa)
    return stored

"""Run logs as small key/value tables."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PreprocessConfig


def run_log(df: DataFrame, config: PreprocessConfig) -> DataFrame:
    """Rows ``(key, value)``: the row count and the settings of a run."""
    # The keys of a run log, here and in kappa_log.
    settings = {
        "Sample size": config.sample_size,
        "Random seed": config.seed,
        "Lemmatization": config.lemmatize,
        "Emoji strategy": config.emoji_strategy,
        "Hashtag strategy": config.hashtag_strategy,
        "Label strategy": config.label_strategy,
    }
    one_row = df.agg(
        F.count("*").cast("string").alias("Total records"),
        *[F.lit(str(value)).alias(key) for key, value in settings.items()],
    )
    return one_row.unpivot([], ["Total records", *settings], "key", "value")


def kappa_log(report: DataFrame) -> DataFrame:
    """The rows that an agreement report adds to a run log."""
    values = {
        "Cohen's Kappa": F.col("kappa"),
        "Kappa interpretation": F.col("interpretation"),
        "N tweets evaluated": F.col("n"),
        "Seed": F.col("seed"),
    }
    texts = report.select([v.cast("string").alias(k) for k, v in values.items()])
    return texts.unpivot([], list(values), "key", "value")


def experiment_log(spark, entries: Mapping[str, object]) -> DataFrame:
    return spark.createDataFrame(
        [(key, str(value)) for key, value in entries.items()], "key string, value string"
    )


def append_log(log: DataFrame, path: str, run: str | None = None, part: str = "log") -> None:
    """Add the rows of a log as ``key: value`` lines to a log folder.

    With ``run``, the lines stand in a folder of that run and part, which a repeated run replaces: a
    run that is started again after a failure leaves its lines once. Without it, lines are appended.
    """
    line = F.concat(F.col("key"), F.lit(": "), F.coalesce("value", F.lit("")))
    lines = log.select(line.alias("value")).coalesce(1)
    if run is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/run={quote(run, safe='')}/part={quote(part, safe='')}")

"""Inputs of a report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.curate import select_existing, with_timestamp
from ..operators.report import EXPLORER_COLUMNS
from ..sources.corpus import read_corpus
from ..sources.delimited import read_metrics
from ..sources.post_store import read_posts, write_posts


class ReportInputs(NamedTuple):
    posts: DataFrame
    base_metrics: DataFrame
    embedding_metrics: DataFrame


def load_report_inputs(
    spark: SparkSession,
    corpus_path: str,
    base_path: str,
    embedding_path: str,
    schema: T.StructType | str | None = None,
) -> ReportInputs:
    """Labelled corpus with parsed dates, and metrics.

    Only the columns that a report reads are kept. ``store_report_inputs`` lays the corpus out for many aggregates.
    """
    read = select_existing(read_corpus(spark, corpus_path, schema), EXPLORER_COLUMNS)
    posts = with_timestamp(read)
    return ReportInputs(
        posts, read_metrics(spark, base_path), read_metrics(spark, embedding_path)
    )


def store_report_inputs(
    spark: SparkSession,
    corpus_path: str,
    store: str,
    schema: T.StructType | str | None = None,
    period: str = "day",
    replace: str = "all",
) -> None:
    """Parse the corpus once; its posts are stored by language and time, sorted by label."""
    read = select_existing(read_corpus(spark, corpus_path, schema), [*EXPLORER_COLUMNS, "lang"])
    write_posts(with_timestamp(read), store, period=period, replace=replace)


def load_stored_inputs(
    spark: SparkSession, store: str, base_path: str, embedding_path: str, **wanted
) -> ReportInputs:
    """The inputs from a store; ``wanted`` are the languages, days and labels of ``read_posts``."""
    return ReportInputs(
        read_posts(spark, store, **wanted), read_metrics(spark, base_path), read_metrics(spark, embedding_path)
    )

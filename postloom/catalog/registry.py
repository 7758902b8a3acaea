"""Registry of queries, and the supplied tables read as a corpus of posts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, shuffles_freed
from ..sources.tables import read_table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The supplied tables of one scale; each is read when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/documents.parquet", spread=True)

    @cached_property
    def posts(self) -> DataFrame:
        """Documents as posts; the event of the same number gives time and counts."""
        events = self.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("created_at"),
            F.floor("value").cast("bigint").alias("retweet_count"),
            F.col("user_id").alias("favorite_count"),
            (F.col("event_type") == "view").alias("retweeted"),
        )
        documents = self.documents.select(
            F.col("doc_id").alias("id"), F.col("text").alias("full_text"), "lang", "source", "n_chars"
        )
        return documents.join(events, "id")

    @cached_property
    def labelled(self) -> DataFrame:
        """The posts with a row in ``labels``: two label columns and their confidences."""
        toxic, quality = F.col("toxic"), F.col("quality")
        first = F.when(toxic == 1, "negativo").when(quality == 1, "positivo").otherwise("neutro")
        second = F.when(quality == 0, "negativo").when(toxic == 0, "positivo").otherwise("neutro")
        marks = self.labels.select(
            F.col("doc_id").alias("id"),
            first.alias("label_sentiment"),
            second.alias("label_secondary"),
        )
        return self.posts.join(marks, "id").withColumns(
            {
                "label_confidence": (F.col("n_chars") % 100) / 100.0,
                "label_conf_secondary": (F.col("n_chars") % 97) / 100.0,
            }
        )


def stored(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it, so that it is computed once."""
    path = shared_dir(t.spark, name)
    with shuffles_freed(t.spark):
        df.write.parquet(path)
    return t.spark.read.parquet(path)


POSTS = """posts AS (
  SELECT d.doc_id AS id, d.text AS full_text, d.lang, d.source, d.n_chars,
         e.ts AS created_at, CAST(floor(e.value) AS BIGINT) AS retweet_count,
         e.user_id AS favorite_count, e.event_type = 'view' AS retweeted
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""

LABELLED = (
    POSTS
    + """, labelled AS (
  SELECT p.*,
         CASE WHEN l.toxic = 1 THEN 'negativo' WHEN l.quality = 1 THEN 'positivo'
              ELSE 'neutro' END AS label_sentiment,
         CASE WHEN l.quality = 0 THEN 'negativo' WHEN l.toxic = 0 THEN 'positivo'
              ELSE 'neutro' END AS label_secondary,
         (p.n_chars % 100) / 100.0::DOUBLE AS label_confidence,
         (p.n_chars % 97) / 100.0::DOUBLE AS label_conf_secondary
  FROM posts p JOIN labels l ON l.doc_id = p.id)"""
)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with its SQL where SQL can say it."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""Sampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sample as SA
from .registry import LABELLED, query


def _digest(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


@query(
    "sa1_sample_n",
    f"SELECT doc_id, text FROM documents ORDER BY {_digest('doc_id')}, doc_id LIMIT 150",
)
def sample_small(t):
    return SA.sample_n(t.documents.select("doc_id", "text"), 150, 42, "doc_id")


@query(
    "sa1_sample_n_large",
    f"SELECT event_id, value FROM events ORDER BY {_digest('event_id', 7)}, event_id LIMIT 2500",
)
def sample_large(t):
    return SA.sample_n(t.events.select("event_id", "value"), 2500, 7, "event_id")


@query(
    "sa2_stratified_sample",
    f"""WITH {LABELLED} SELECT id, label_sentiment FROM labelled
QUALIFY row_number() OVER (PARTITION BY label_sentiment ORDER BY {_digest('id')}, id) <= 50""",
)
def stratified(t):
    # Rows that tie are equal in both columns, so no text has to go through the joins.
    return SA.stratified_sample(t.labelled.select("id", "label_sentiment"), 150, 42, "id")


@query(
    "sa2_stratified_sample_large",
    f"""SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'error')
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_digest('event_id')}, event_id) <= 1200""",
)
def stratified_large(t):
    kinds = ("view", "click", "error")
    rows = t.events.select("event_id", "event_type")
    return SA.stratified_sample(rows, 3600, 42, "event_id", "event_type", kinds)


@query(
    "sa3_hash_split",
    f"""SELECT doc_id, CASE WHEN ('0x' || left({_digest('doc_id')}, 8))::UBIGINT % 100 < 20
  THEN 'test' ELSE 'train' END AS part FROM documents""",
)
def split(t):
    train, test = SA.hash_split(t.documents.select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


# Keys that are null in a third of the rows and repeat in the others.
LOOSE_KEY = "CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END"


def _loose(t):
    return t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50).alias("k"))


@query("sa1_sample_n_loose_keys", "SELECT least(1500, count(*)) AS n, least(1500, count(*)) AS n_rows FROM events")
def sample_loose(t):
    drawn = SA.sample_n(_loose(t), 1500, 42, "k")
    return drawn.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_rows"))


@query(
    "sa3_hash_split_loose_keys",
    f"""SELECT event_id, CASE WHEN ('0x' || left(md5('42:' || coalesce(CAST({LOOSE_KEY} AS VARCHAR), '')), 8))::UBIGINT
  % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM events""",
)
def split_loose(t):
    train, test = SA.hash_split(_loose(t), "k")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.select("event_id", "part")

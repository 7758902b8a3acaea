"""Posts stored for reports: Parquet by language and day, each file sorted by label.

A report that asks for some languages and a range of days opens the folders of these only, and
within a file the row groups and pages whose labels may match. The folders' columns are derived, so
the posts keep their own columns as they were: a null language, an empty one and posts without a
time each have a folder of their own.

Rows are dealt to tasks by adaptive rebalancing: a language and day that hold much of the corpus are
split over many tasks and files, small ones share a task.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANG_PART, TIME_PART = "part_lang", "part_time"
PERIODS = ("day", "month", "year")


def _lang_key(lang: Column) -> Column:
    """Folder name of a language; null has one that no language can have."""
    return F.coalesce(F.concat(F.lit("is-"), lang), F.lit("null"))


def _start(day: datetime.date, period: str) -> Column:
    return F.lit(day.replace(day=1 if period != "day" else day.day, month=1 if period == "year" else day.month))


def write_posts(
    df: DataFrame,
    path: str,
    lang: str = "lang",
    ts: str = "created_at",
    label: str = "label_sentiment",
    period: str = "day",
    replace: str = "all",
) -> None:
    """Store posts, also those without a language column. ``period`` sets how much time a folder holds; a store keeps to one.

    ``replace="all"`` writes the store anew. ``"touched"`` replaces the folders that occur in ``df``
    whole and leaves the others, so a load that is repeated does not double its rows.
    """
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    if replace not in ("all", "touched"):
        raise ValueError(f"unknown way to replace {replace!r}")
    taken = {c.lower() for c in df.columns} & {LANG_PART, TIME_PART}
    if taken:
        raise ValueError(f"columns named as the folders: {sorted(taken)}")
    known = F.col(lang).cast("string") if lang in df.columns else F.lit(None).cast("string")
    rows = df.withColumns({
        LANG_PART: _lang_key(known),
        TIME_PART: F.to_date(F.date_trunc(period, ts)),
    })
    dealt = rows.hint("rebalance", LANG_PART, TIME_PART)
    # The writer wants rows by folder and keeps an order that begins so.
    ordered = dealt.sortWithinPartitions(LANG_PART, TIME_PART, label, ts)
    mode = "static" if replace == "all" else "dynamic"
    ordered.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(LANG_PART, TIME_PART).parquet(path)


def read_posts(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    langs: Sequence[str | None] | None = None,
    first: datetime.date | None = None,
    last: datetime.date | None = None,
    labels: Sequence[str] | None = None,
    lang: str = "lang",
    ts: str = "created_at",
    label: str = "label_sentiment",
    period: str = "day",
) -> DataFrame:
    """Stored posts of the given languages, days (both inclusive) and labels; None asks for all.

    Posts without a time are returned only if no day is asked for. ``schema`` is that of the posts.
    """
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    reader = spark.read
    if schema is not None:
        folders = [T.StructField(LANG_PART, T.StringType()), T.StructField(TIME_PART, T.DateType())]
        reader = reader.schema(T.StructType([*schema.fields, *folders]))
    rows = reader.parquet(path)
    if langs is not None:
        known = [v for v in langs if v is not None]
        keys = [f"is-{v}" for v in known] + ["null"] * (len(known) < len(langs))
        rows = rows.filter(F.col(LANG_PART).isin(keys) if keys else F.lit(False))
    # Instants fall on other days in other time zones, local times do not.
    slack = datetime.timedelta(days=rows.schema[ts].dataType.typeName() == "timestamp")
    after = datetime.timedelta(days=1)
    if first is not None:
        rows = rows.filter((F.col(TIME_PART) >= _start(first - slack, period)) & (F.col(ts) >= F.lit(first)))
    if last is not None:
        rows = rows.filter((F.col(TIME_PART) <= _start(last + slack, period)) & (F.col(ts) < F.lit(last + after)))
    if labels is not None:
        rows = rows.filter(F.col(label).isin(list(labels)) if labels else F.lit(False))
    return rows.drop(LANG_PART, TIME_PART)

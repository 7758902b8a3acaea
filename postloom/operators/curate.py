"""Curation: which columns and rows of a raw export stay, and their anonymous ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SENSITIVE
from ..functions.hashing import hashed_id
from .profile import null_ratios


def sparse_columns(df: DataFrame, threshold: float = 0.95) -> list[str]:
    """Names of the columns whose null ratio is strictly above the threshold (runs one job)."""
    rows = null_ratios(df).filter(F.col("ratio") > threshold).collect()  # one row per column
    return [row["column"] for row in rows]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def drop_sensitive(df: DataFrame, cols: Sequence[str] = SENSITIVE) -> DataFrame:
    """Drop personal columns; names that are absent are ignored."""
    return df.drop(*cols)


def keep_language(df: DataFrame, lang: str = "es", col: str = "lang") -> DataFrame:
    return df.filter(F.col(col) == lang)


def dedup_keep_first(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order_by``. Nulls in the key count as equal.

    A minimum per key combines on the map side, so a key with very many copies costs one row per
    task in the shuffle. Two hashes stand for the key, so sorting compares short values. Ties in
    ``order_by`` are settled by the other columns.
    """
    rest = [c for c in df.columns if c != key and c not in order_by]
    ordered = [c for c in order_by if c != key]
    digest = [F.xxhash64(key), F.xxhash64(F.lit(1), key), F.col(key).isNull()]
    first = F.min(F.struct(*ordered, *rest, key)).alias("__first")
    grouped = df.groupBy(*[d.alias(f"__d{i}") for i, d in enumerate(digest)]).agg(first)
    return grouped.select("__first.*").select(df.columns)


def drop_retweets(df: DataFrame, col: str = "retweeted") -> DataFrame:
    """Keep rows whose flag is false; a null flag drops the row."""
    return df.filter(~F.col(col))


def with_hashed_id(
    df: DataFrame,
    cols: Sequence[str] = ("full_text", "created_at"),
    out: str = "tweet_id_hashed",
) -> DataFrame:
    return df.withColumn(out, hashed_id(*[F.col(c).cast("string") for c in cols]))


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select([c for c in cols if c in df.columns])


def filter_posts(
    df: DataFrame,
    labels: Sequence[str],
    hour_from: int,
    hour_to: int,
    label: str = "label_sentiment",
    ts: str = "created_at",
) -> DataFrame:
    """Rows with one of the labels and an hour in the inclusive range."""
    return df.filter(F.col(label).isin(*labels) & F.hour(ts).between(hour_from, hour_to))


def hour_bounds(df: DataFrame, ts: str = "created_at") -> DataFrame:
    hour = F.hour(ts)
    return df.agg(F.min(hour).alias("hour_min"), F.max(hour).alias("hour_max"))


def parse_timestamp(raw: Column) -> Column:
    """UTC time (without zone) of an epoch-millisecond, ISO or ``Sun Dec 11 18:00:00 +0000 2022``
    string; null if none fits."""
    text = F.trim(raw.cast("string"))
    epoch = F.timestamp_millis(F.when(text.rlike(r"^-?\d{1,15}$"), text).cast("bigint"))
    # Spark refuses weekday names in patterns, so they are cut off.
    posted = F.try_to_timestamp(F.substring(text, 5, 30), F.lit("MMM dd HH:mm:ss Z yyyy"))
    zoned = F.when(
        text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"),
        text.try_cast("timestamp"),
    )
    instant = F.coalesce(
        epoch, F.when(text.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} "), posted), zoned
    )
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1000000).cast("decimal(18,6)")
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))
    return F.coalesce(zero + F.make_dt_interval(secs=seconds), plain)


def with_timestamp(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Parse the column and drop the rows that fail."""
    kind = df.schema[col].dataType.typeName()
    if kind not in ("timestamp", "timestamp_ntz"):
        df = df.withColumn(col, parse_timestamp(F.col(col)))
    return df.filter(F.col(col).isNotNull())

"""JSON Lines corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a raw export; see the README for the tables of the later stages.
RAW_SCHEMA = (
    "id string, name string, screen_name string, location string, created_at string,"
    " full_text string, lang string, retweeted boolean, source string, retweet_count bigint,"
    " favorite_count bigint, followers_count bigint, friends_count bigint,"
    " account_created_at string, truncated boolean, favorited boolean, is_quote_status boolean,"
    " in_reply_to_status_id bigint, in_reply_to_user_id bigint, in_reply_to_screen_name string"
)


def read_corpus(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read a corpus; a declared schema saves the pass that infers one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line, letters as they are, nulls kept as fields."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def with_epoch_times(df: DataFrame) -> DataFrame:
    """Times as epoch milliseconds, the form they have in processed corpora."""
    times = [f.name for f in df.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def millis(name: str):
        if df.schema[name].dataType.typeName() == "timestamp":
            return F.unix_millis(name)
        return F.timestamp_diff("MILLISECOND", zero, F.col(name))

    return df.withColumns({c: millis(c) for c in times})

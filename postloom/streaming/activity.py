"""Activity counts while posts keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.curate import with_timestamp
from ..operators.report import activity


def stream_corpus(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """New JSON Lines files of a corpus folder as a stream."""
    return spark.readStream.schema(schema).json(path)


def stream_activity(
    posts: DataFrame,
    ts: str = "created_at",
    label: str = "label_sentiment",
    width: str = "30 minutes",
    lateness: str = "1 hour",
) -> DataFrame:
    """The batch ``activity`` on a stream: state for a bucket is dropped once ``lateness`` is over."""
    timed = with_timestamp(posts, ts)
    if timed.schema[ts].dataType.typeName() != "timestamp":
        timed = timed.withColumn(ts, timed[ts].cast("timestamp"))
    return activity(timed.withWatermark(ts, lateness), ts, label, width)


def run_activity(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what has arrived and stop; the next run goes on where this one ended.

    Each batch writes the counts that it changed to a folder of its number, so a batch that is
    repeated after a failure replaces its rows. Source offsets and window counts are in ``checkpoint``.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = counts.writeStream.outputMode("update").foreachBatch(write)
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_activity(spark: SparkSession, path: str, ts: str = "created_at", label: str = "label_sentiment") -> DataFrame:
    """The latest count of each bucket and label that ``run_activity`` has written."""
    rows = spark.read.parquet(path)
    return rows.groupBy(ts, label).agg(F.max_by("count", "batch").alias("count"))

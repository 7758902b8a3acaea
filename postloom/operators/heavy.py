"""The most frequent values of a column without shuffling every distinct value.

1. Each task counts its values in a summary of bounded size. When it is full, the count of rank
   ``capacity + 1`` is taken off all counts and what falls to zero is forgotten; what was taken off
   bounds by how much any count of that task is too low.
2. Summaries are added per value. With the sum of all bounds, every value has a lower and an upper
   count; those whose upper count reaches the k-th largest lower one are candidates.
3. The candidates are counted exactly in a second pass. If the k-th of them occurs more often than a value
   could that no summary kept, nothing was missed; otherwise all values are counted.

The result is exact in any case. What is shuffled is in proportion to ``capacity`` per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shared_dir

CAPACITY = 20_000
#: Candidates up to this number are sent to all tasks; with more, all values are counted.
MAX_CANDIDATES = 200_000
_SLICE = 4096


class Summary:
    """Counts of the most frequent values, each too low by ``error`` at most."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.counts: dict[str, int] = {}

    def add(self, values: pa.Array) -> None:
        found = pc.value_counts(values)
        counts = self.counts
        for value, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
            counts[value] = counts.get(value, 0) + n
        if len(counts) > 2 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.capacity:
            sizes = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            cut = int(np.partition(sizes, -self.capacity - 1)[-self.capacity - 1])
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
            self.error += cut


def summaries(df: DataFrame, values: str, capacity: int) -> DataFrame:
    """Rows ``(value, n)`` of one summary per task over an array column; the null value has its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                summary.add(batch.column(0).slice(at, _SLICE).flatten().drop_null())
        summary.shrink()
        names = [None, *summary.counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([summary.error, *summary.counts.values()], pa.int64())], names=["value", "n"]
        )

    return df.select(values).mapInArrow(run, "value string, n bigint")


def top_k(df: DataFrame, values: str, k: int, capacity: int = CAPACITY, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """Rows ``(value, n)``: the ``k`` most frequent strings of an array column, ties by value.

    Null arrays and null strings count for nothing. Two passes over ``values``, or three if the
    bounds do not close, so store what is dear to compute.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "summaries")
    summaries(df, values, capacity).groupBy("value").agg(F.sum("n").alias("n")).write.parquet(path)
    merged = spark.read.parquet(path)
    order = [F.desc("n"), F.asc("value")]
    error = merged.filter("value IS NULL").agg(F.sum("n")).first()[0] or 0
    lower = merged.filter("value IS NOT NULL")
    if not error:
        return lower.orderBy(*order).limit(k)
    least = lower.orderBy(*order).limit(k).agg(F.min("n")).first()[0] or 0
    candidates = lower.filter(F.col("n") + error >= least).select("value")
    all_values = df.select(F.explode(values).alias("value")).filter("value IS NOT NULL")
    if candidates.count() <= max_candidates:
        named = all_values.join(F.broadcast(candidates), "value", "left_semi")
        path = shared_dir(spark, "candidates")
        named.groupBy("value").agg(F.count("*").alias("n")).orderBy(*order).limit(k).write.parquet(path)
        exact = spark.read.parquet(path)
        n_rows, last = exact.agg(F.count("*"), F.min("n")).first()
        if n_rows == k and last > error:
            return exact.orderBy(*order)
    return all_values.groupBy("value").agg(F.count("*").alias("n")).orderBy(*order).limit(k)


def top_hashtags(df: DataFrame, k: int = 10, text: str = "full_text", capacity: int = CAPACITY) -> DataFrame:
    """The most frequent hashtags, ties by name."""
    return top_k(df.select(X.extract_hashtags(F.col(text)).alias("tags")), "tags", k, capacity).withColumnRenamed("value", "hashtag")


def top_terms(df: DataFrame, k: int = 1000, text: str = "clean_text", capacity: int = CAPACITY) -> DataFrame:
    """The most frequent terms with their occurrences, ties by term."""
    return top_k(df.select(X.terms(F.col(text)).alias("terms")), "terms", k, capacity).select(
        F.col("value").alias("term"), F.col("n").alias("total")
    )

"""Row numbers in a given order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def with_row_number(df: DataFrame, order_by: Sequence[str | Column], out: str = "row_number") -> DataFrame:
    """Number rows from 0 in the order of ``order_by``; a hash of the whole row settles ties.

    Rows are sorted by range and stored with their place in their range; the counts of the ranges, one
    row per task, give each range its first number.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "ordered")
    keys = [*order_by, F.xxhash64(*df.columns)]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.withColumn("__place", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    # The id holds the number of its task from bit 33 on.
    part = F.shiftright("__place", 33)
    starts, before = [], 0
    for number, n in stored.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((number, before))
        before += n
    ranges = spark.createDataFrame(starts, "__part bigint, __start bigint")
    numbered = stored.withColumn("__part", part).join(F.broadcast(ranges), "__part")
    at = F.col("__start") + F.col("__place").bitwiseAND(F.lit(2**33 - 1))
    return numbered.withColumn(out, at).select(*df.columns, out)

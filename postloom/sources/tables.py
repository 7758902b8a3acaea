"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Read Parquet.

    A file with few row groups is read by few tasks however many cores are free. With ``spread``,
    the rows of such an input are dealt out to all cores, which pays before costly text work; an
    input with a task for each core is never shuffled.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df

"""Derived tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local master that lacks it uses the warehouse."""
    return shared_root(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

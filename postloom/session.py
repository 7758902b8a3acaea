"""Session with the settings the operators are tuned for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bytes of input per shuffle task: tasks fit in memory, and adaptive execution merges small ones.
SHUFFLE_TASK_BYTES = 128 * 1024 * 1024


def build_session(
    app: str = "postloom", input_bytes: int | None = None, **settings: str
) -> SparkSession:
    """A session; the cluster manager and sizes come from ``spark-submit`` or ``settings``.

    With ``input_bytes`` the number of shuffle tasks follows the size of the input.
    """
    chosen = dict(SETTINGS)
    if input_bytes is not None:
        chosen["spark.sql.shuffle.partitions"] = str(max(200, -(-input_bytes // SHUFFLE_TASK_BYTES)))
    builder = SparkSession.builder.appName(app)
    for key, value in {**chosen, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors can reach, under ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one machine, may go without the setting;
    the folder then lies in the warehouse.
    """
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/postloom"
    return root.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run within are deleted as each ends, not when the driver collects garbage.

    For queries whose result is stored: nothing reads their shuffles again.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)

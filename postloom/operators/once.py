"""Costly row-wise work, such as a model's, done once per distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

# A text with more than this share of all rows is joined by broadcast: at most its inverse many are.
HOT_SHARE = 0.001


def once_per_text(
    df: DataFrame, text: str, add: Callable[[DataFrame], DataFrame], hot_share: float = HOT_SHARE
) -> DataFrame:
    """``add(df)`` for an ``add`` whose new columns follow from ``text`` alone, run once per distinct text.

    Distinct texts are found by 128 bits of hashes, which combine in each task, so copies are not
    shuffled. They are worked on in order of length, so that a model's batches hold texts of like
    length, and the results are stored: no later step runs the model again. They are joined back by
    hash. Texts above ``hot_share`` of the rows are few and come by broadcast, so no task gathers a
    frequent text's rows; the others are shuffled. Null texts count as one text, an empty one as another.
    """
    spark = df.sparkSession
    names = ["__text_1", "__text_2"]
    gone = F.col(text).isNull()
    digest = [F.xxhash64(gone, text).alias(names[0]), F.xxhash64(F.lit(1), text, gone).alias(names[1])]
    keyed = df.select("*", *digest)
    counted = keyed.groupBy(*names).agg(F.any_value(text).alias(text), F.count("*").alias("__rows"))
    ordered = counted.sortWithinPartitions(F.octet_length(text))
    taken = {c.lower() for c in df.columns}
    done = add(ordered)
    new = [c for c in done.columns if c not in ordered.columns]
    if clash := [c for c in new if c.lower() in taken]:
        raise ValueError(f"columns {clash} exist")
    path = shared_dir(spark, "once")
    results = done.select(*names, "__rows", *new)
    results.write.parquet(path)
    results = spark.read.schema(results.schema).parquet(path)
    least = hot_share * (results.agg(F.sum("__rows")).first()[0] or 0)
    hot = F.broadcast(results.filter(F.col("__rows") > least).drop("__rows"))
    rare = results.filter(F.col("__rows") <= least).drop("__rows")
    few = keyed.join(hot, names)
    rest = keyed.join(hot.select(*names), names, "left_anti").join(rare.hint("merge"), names)
    return few.unionByName(rest).select(*df.columns, *new)

"""Agreement of two label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLASSES

# Lower bound, name and note of each level of agreement.
KAPPA_LEVELS = (
    (0.80, "casi perfecto", ""),
    (0.60, "sustancial", "aceptable para TFM"),
    (0.40, "moderado", "reportar y justificar"),
    (None, "pobre", "revisar criterios o muestra"),
)


def label_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``(a, b, n)`` over the rows where both labels are given."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(kappa, n)``; null if chance agreement is total.

    The labels are counted once; the rest works on one row per pair of labels.
    """
    sides = label_pairs(df, a, b).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("a").alias("label"),
                    F.col("n").alias("in_a"),
                    F.lit(0).cast("bigint").alias("in_b"),
                    F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"),
                ),
                F.struct(
                    F.col("b").alias("label"),
                    F.lit(0).cast("bigint").alias("in_a"),
                    F.col("n").alias("in_b"),
                    F.lit(0).cast("bigint").alias("same"),
                ),
            )
        )
    )
    margins = sides.groupBy("label").agg(
        F.sum("in_a").cast("double").alias("in_a"),
        F.sum("in_b").cast("double").alias("in_b"),
        F.sum("same").alias("same"),
    )
    total = margins.agg(
        F.sum("in_a").alias("n"),
        F.sum("same").alias("same"),
        F.sum(F.col("in_a") * F.col("in_b")).alias("products"),
    )
    observed = F.try_divide(F.col("same").cast("double"), F.col("n"))
    chance = F.try_divide(F.col("products"), F.col("n") * F.col("n"))
    kappa = F.try_divide(observed - chance, 1 - chance)
    return total.select(
        F.bround(kappa, 4).alias("kappa"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def interpret_kappa(kappa: Column, note: bool = False) -> Column:
    """The name of the level of agreement, with its note in brackets if wanted."""
    named = None
    for bound, name, remark in KAPPA_LEVELS:
        text = F.lit(f"{name} ({remark})" if note and remark else name)
        if bound is None:
            return F.when(kappa.isNotNull(), named.otherwise(text))
        named = F.when(kappa >= bound, text) if named is None else named.when(kappa >= bound, text)


def kappa_report(df: DataFrame, a: str, b: str, seed: int = 42, note: bool = False) -> DataFrame:
    return cohen_kappa(df, a, b).select(
        "kappa",
        interpret_kappa(F.col("kappa"), note).alias("interpretation"),
        "n",
        F.lit(seed).alias("seed"),
    )


def agreement_matrix(
    df: DataFrame, a: str, b: str, classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Every pair of classes with its count and its share of the row, zeros included."""
    known = F.col(a).isin(*classes) & F.col(b).isin(*classes)
    counts = label_pairs(df.filter(known), a, b)
    pairs = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x in classes for y in classes]
    grid = df.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    dense = grid.join(counts, ["a", "b"], "left").select(
        "a", "b", F.coalesce("n", F.lit(0)).alias("count")
    )
    row = F.sum("count").over(Window.partitionBy("a"))
    return dense.withColumn("pct", F.bround(F.try_divide(F.col("count") * 100.0, row), 1))

"""Exploration: shape, nulls, summary statistics, frequencies, lengths."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bounded import as_double, exact_quantiles, name_of
from .rows import with_row_number

QUARTILES = (0.25, 0.5, 0.75)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names and types with the row count."""
    kinds = F.array(
        *[F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type")) for name, kind in df.dtypes]
    )
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(kinds), "n_rows")


def assert_absent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows ``(column, present, n_rows)`` for columns that should be gone from the table."""
    checks = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present")) for c in cols]
    )
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(checks), "n_rows")


def _per_column(df: DataFrame, measure, value: str) -> DataFrame:
    one_row = df.agg(*[measure(F.col(c)).alias(c) for c in df.columns])
    return one_row.unpivot([], df.columns, "column", value)


def null_counts(df: DataFrame) -> DataFrame:
    return _per_column(df, lambda c: F.count_if(c.isNull()), "nulls")


def null_ratios(df: DataFrame) -> DataFrame:
    return _per_column(df, lambda c: F.avg(c.isNull().cast("int")), "ratio")


def null_patterns(df: DataFrame) -> DataFrame:
    """How many rows share each pattern of missing (1) and present (0) columns."""
    marks = [F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns]
    return df.groupBy(F.concat(*marks).alias("pattern")).agg(F.count("*").alias("n"))


def null_matrix(df: DataFrame, order_by: Sequence[str], bins: int = 100) -> DataFrame:
    """Where nulls lie: rows in order are cut into ``bins`` equal parts; the share of nulls of each
    part and column, as rows ``(bin, column, ratio)``."""
    marks = {c: F.col(c).isNull() for c in df.columns}
    flags = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)], *[m.alias(f"__n{i}") for i, m in enumerate(marks.values())])
    numbered = with_row_number(flags, [f"__o{i}" for i in range(len(order_by))], "__row")
    total = numbered.count()
    place = F.floor(F.col("__row") * bins / F.lit(max(1, total))).cast("int").alias("bin")
    shares = [F.struct(F.lit(c).alias("column"), F.avg(F.col(f"__n{i}").cast("int")).alias("ratio")) for i, c in enumerate(marks)]
    return numbered.groupBy(place).agg(F.array(*shares).alias("shares")).select("bin", F.inline("shares"))


class CountsOnTheWay:
    """Rows that pass marked places of a plan, counted while the plan's own result is written.

    ``mark`` the stages, write the result once, then ``table`` gives the counts without another scan.
    A stage that Spark computes again after a lost executor counts its rows again.
    """

    def __init__(self) -> None:
        self.found: dict[str, Observation] = {}

    def mark(self, df: DataFrame, stage: str) -> DataFrame:
        self.found[stage] = Observation(f"{stage}-{uuid.uuid4().hex}")
        return df.observe(self.found[stage], F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows ``(stage, n)``; waits for the write."""
        return spark.createDataFrame([(s, o.get["n"]) for s, o in self.found.items()], "stage string, n bigint")


def stage_counts(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows left after each stage, all stages in one pass.

    ``stages`` maps a name to the condition that a row of that stage meets.
    """
    one_row = df.agg(*[F.count_if(cond).alias(name) for name, cond in stages.items()])
    return one_row.unpivot([], list(stages), "stage", "n")


def counts_of(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each stage's own table, for stages that are more than a condition on a row."""
    parts = [df.agg(F.lit(name).alias("stage"), F.count("*").alias("n")) for name, df in stages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Frequency of each non-null value, most frequent first, ties by value."""
    counts = (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
    )
    return counts if k is None else counts.limit(k)


def with_length(df: DataFrame, text: str = "full_text", out: str = "tweet_length") -> DataFrame:
    """Length in code points; a null text counts as the word ``None``."""
    return df.withColumn(out, F.length(F.coalesce(F.col(text), F.lit("None"))))


def mean_length(df: DataFrame, text: str = "full_text") -> DataFrame:
    return with_length(df, text, "__length").agg(F.avg("__length").alias("mean_length"))


def equal_width_histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins over [min, max], the last one closed, empty bins included."""
    span = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    # With a single value the span is taken as one, half on each side.
    one_row = F.broadcast(
        span.select(
            F.lit(0).alias("__at"),
            F.when(lo == hi, lo - 0.5).otherwise(lo).alias("__start"),
            (F.when(lo == hi, F.lit(1.0)).otherwise(hi - lo) / bins).alias("__width"),
        )
    )
    start, width = F.col("__start"), F.col("__width")
    values = df.filter(F.col(col).isNotNull()).select(F.lit(0).alias("__at"), F.col(col).alias("__x"))
    place = F.least(F.floor((F.col("__x") - start) / width), F.lit(bins - 1)).cast("int")
    counts = values.join(one_row, "__at").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.lit(0).alias("__at"), F.col("id").cast("int").alias("bin"))
    return grid.join(one_row, "__at").join(counts, "bin", "left").select(
        "bin",
        (start + F.col("bin") * width).alias("left_edge"),
        (start + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: count, and unique / top / freq for categories or
    mean / std / min / quartiles / max for numbers and timestamps (as epoch seconds)."""
    cols = list(cols or df.columns)
    quantity = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)
    numbers = [c for c in cols if isinstance(df.schema[c].dataType, quantity)]
    words = [c for c in cols if c not in numbers]
    parts = []
    if numbers:
        parts.append(_describe_numbers(df, numbers))
    if words:
        parts.append(_describe_categories(df, words))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    order = ["column", "count", "unique", "top", "freq", "mean", "std", "min"]
    order += [name_of(p) for p in QUARTILES] + ["max"]
    for name in set(order) - set(result.columns):
        kind = "string" if name == "top" else "bigint" if name in ("unique", "freq") else "double"
        result = result.withColumn(name, F.lit(None).cast(kind))
    return result.select(order)


def _describe_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    doubles = df.select([F.nanvl(as_double(df, c), F.lit(None)).alias(c) for c in cols])
    one_row = doubles.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    basic = one_row.select(F.inline(F.array(*cols)))
    quartiles = exact_quantiles(df, cols, QUARTILES)
    # Both sides hold one row per column.
    return basic.join(quartiles, "column", "left")


def _describe_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    strings = df.select([F.col(c).cast("string").alias(c) for c in cols])
    # Two hashes stand for the value, so that long texts are neither sorted nor compared.
    digest = [F.xxhash64("value"), F.xxhash64(F.lit(1), "value"), F.col("value").isNull()]
    counts = (
        strings.unpivot([], cols, "column", "value")
        .groupBy("column", *[d.alias(f"__d{i}") for i, d in enumerate(digest)])
        .agg(F.count("*").alias("n"), F.min("value").alias("value"))
    )
    # Nulls stay as rows up to here, so that an all-null column still yields its row.
    seen = F.when(F.col("value").isNotNull(), F.col("n"))
    totals = counts.groupBy("column").agg(
        F.coalesce(F.sum(seen), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        F.max(seen).alias("freq"),
    )
    # One row per column on the right; the sums above need no sort of the distinct values.
    most = F.broadcast(totals.select("column", "freq"))
    best = counts.join(most, "column").filter((F.col("n") == F.col("freq")) & F.col("value").isNotNull())
    top = best.groupBy("column").agg(F.min("value").alias("top"))
    return totals.join(top, "column", "left")

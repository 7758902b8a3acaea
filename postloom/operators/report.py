"""Aggregates behind the charts of a corpus report."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES, REPORT_STOPWORDS
from ..functions import patterns as P
from ..functions.text import truncate_text
from .curate import select_existing
from .profile import value_counts

# The columns that the report's explorer shows.
EXPLORER_COLUMNS = (
    "created_at", "full_text", "clean_text", "label_sentiment", "label_confidence",
    "label_secondary", "label_conf_secondary", "retweet_count", "favorite_count",
    "followers_count", "friends_count", "source", "account_created_at",
)


def kpis(
    df: DataFrame,
    label: str = "label_sentiment",
    second: str = "label_secondary",
    confidence: str = "label_confidence",
    classes: Sequence[str] = CLASSES,
) -> DataFrame:
    """Total, count and percentage per class, agreement and mean confidence in percent."""
    total = F.count("*")
    per_class: list[Column] = []
    for name in classes:
        hits = F.count_if(F.col(label) == name)
        per_class += [hits.alias(name), F.try_divide(hits * 100.0, total).alias(f"{name}_pct")]
    same = F.count_if(F.col(label) == F.col(second))
    return df.agg(
        total.alias("total"),
        *per_class,
        F.try_divide(same * 100.0, total).alias("agreement_pct"),
        (F.avg(confidence) * 100).alias("confidence_pct"),
    )


def activity(
    df: DataFrame,
    ts: str = "created_at",
    label: str = "label_sentiment",
    width: str = "30 minutes",
) -> DataFrame:
    """Posts per time bucket and label, present buckets only. Also works on a stream."""
    rows = df.filter(F.col(label).isNotNull())
    counts = rows.groupBy(F.window(ts, width).alias("bucket"), label).agg(
        F.count("*").alias("count")
    )
    return counts.select(F.col("bucket.start").alias(ts), label, "count")


def class_shares(
    df: DataFrame, label: str = "label_sentiment", classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Count and percentage of each listed class, absent ones as zero, in one pass."""
    total = F.count("*").alias("total")
    hits = [F.count_if(F.col(label) == name).alias(name) for name in classes]
    one_row = df.agg(total, *hits)
    return one_row.unpivot(["total"], list(classes), label, "n").select(
        label, "n", F.try_divide(F.col("n") * 100.0, F.col("total")).alias("pct")
    )


def nice_step(low: float, high: float, max_bins: int = 20) -> float:
    """A round bin width (1, 2 or 5 times a power of ten) for at most ``max_bins`` bins."""
    span = high - low or abs(low) or 1.0
    digits = math.ceil(math.log10(max_bins))
    step = 10.0 ** (math.floor(math.log10(span) + 0.5) - digits)
    while math.ceil(span / step) > max_bins:
        step *= 10
    for part in (5, 2):
        if span / (step / part) <= max_bins:
            step /= part
    return step


def confidence_histogram(
    df: DataFrame,
    cols: Sequence[str] = ("label_confidence", "label_conf_secondary"),
    step: float | None = None,
    max_bins: int = 20,
) -> DataFrame:
    """Counts per annotator column and bin. Without ``step`` one is chosen from the value range."""
    long = df.select(*cols).unpivot([], list(cols), "annotator", "confidence")
    long = long.filter(F.col("confidence").isNotNull())
    if step is None:
        span = long.agg(F.min("confidence"), F.max("confidence")).first()  # one row
        step = nice_step(span[0] or 0.0, span[1] if span[1] is not None else 1.0, max_bins)
    # Steps such as 0.05 are not exact in binary; a tiny shift keeps bin edges in their own bin.
    place = F.floor(F.col("confidence") / step + 1e-9).cast("bigint")
    counts = long.groupBy("annotator", place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("annotator", F.round(F.col("bin") * step, 9).alias("bin_start"), "n")


def top_words(
    df: DataFrame,
    word_class: str,
    k: int = 80,
    text: str = "clean_text",
    label: str = "label_sentiment",
    stopwords: Sequence[str] = REPORT_STOPWORDS,
    drop_numbers: bool = True,
    fold_plurals: bool = True,
) -> DataFrame:
    """The most frequent words of one class, ties by word.

    A possessive ``'s`` is cut off, stop words and (by default) numbers are left out, and a
    plural in ``-s`` counts for its singular if that occurs too.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(P.CLOUD_WORD), F.lit(0))
    words = df.filter(F.col(label) == word_class).select(F.explode(found).alias("word"))
    words = words.select(F.regexp_replace("word", "'s$", "").alias("word"))
    kept = words.filter(~F.col("word").isin(*stopwords))
    if drop_numbers:
        kept = kept.filter(~F.col("word").rlike(r"^\p{Nd}+$"))
    counts = kept.groupBy("word").agg(F.count("*").alias("n"))
    if fold_plurals:
        counts = _fold_plurals(counts)
    return counts.orderBy(F.desc("n"), "word").limit(k)


def _fold_plurals(counts: DataFrame) -> DataFrame:
    """Works on one row per word, so the join has no hot keys."""
    plural = F.col("word").endswith("s") & ~F.col("word").endswith("ss")
    singular = F.when(plural, F.expr("left(word, length(word) - 1)"))
    known = counts.select(F.col("word").alias("base"))
    named = counts.withColumn("base", singular).join(
        known.withColumn("seen", F.lit(True)), "base", "left"
    )
    word = F.when(F.col("seen"), F.col("base")).otherwise(F.col("word"))
    return named.groupBy(word.alias("word")).agg(F.sum("n").alias("n"))


def top_values(df: DataFrame, col: str = "source", k: int = 7) -> DataFrame:
    return value_counts(df, col, k)


def top_posts(
    df: DataFrame,
    post_class: str,
    by: str = "retweet_count",
    k: int = 5,
    key: str = "id",
    cols: Sequence[str] = ("full_text", "retweet_count", "favorite_count", "label_confidence"),
    label: str = "label_sentiment",
    limit: int = 220,
) -> DataFrame:
    """The posts of a class with the highest count: texts cut for display, confidence in percent."""
    rows = df.filter((F.col(label) == post_class) & F.col(by).isNotNull())
    top = select_existing(rows.orderBy(F.desc(by), key).limit(k), [key, *cols])
    if "full_text" in top.columns:
        top = top.withColumn("full_text", truncate_text(F.col("full_text"), limit))
    if "label_confidence" in top.columns:
        pct = F.bround(F.col("label_confidence") * 100, 0).cast("int")
        top = top.withColumn("confidence_pct", F.concat(pct.cast("string"), F.lit("%")))
    return top


def compare_metrics(base: DataFrame, embedded: DataFrame) -> DataFrame:
    """Both metrics tables under each other with their type, best F1 first."""
    tagged = base.withColumn("tipo", F.lit("TF-IDF")).unionByName(
        embedded.withColumn("tipo", F.lit("Embeddings"))
    )
    return tagged.orderBy(F.desc("f1"), "model")


def format_metrics(df: DataFrame, cols: Sequence[str] = ("precision", "recall", "f1")) -> DataFrame:
    return df.withColumns({c: F.format_number(c, 3) for c in cols})


def explore(
    df: DataFrame,
    order_by: Sequence[str],
    n: int | None = 100,
    cols: Sequence[str] = EXPLORER_COLUMNS,
) -> DataFrame:
    """The first ``n`` rows (all rows without ``n``) with the columns worth reading."""
    rows = df.orderBy(*order_by)
    return select_existing(rows if n is None else rows.limit(n), cols)

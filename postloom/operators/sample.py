"""Seeded samples and splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES
from ..functions.hashing import hash_number, seeded_hash
from .bounded import take_by_hash

BUCKETS = 100


def sample_n(df: DataFrame, n: int, seed: int, key: str, check: bool = False) -> DataFrame:
    """Exactly ``n`` rows; with ``check`` a table with fewer rows is an error."""
    if check and df.limit(n).count() < n:
        raise ValueError(f"cannot take {n} rows: the table has fewer")
    return take_by_hash(df, n, seed, key)


def stratified_sample(
    df: DataFrame,
    n: int,
    seed: int,
    key: str,
    label: str = "label_sentiment",
    classes: Sequence[str] = CLASSES,
) -> DataFrame:
    """``max(1, n // 3)`` rows of each class, all rows of a shorter class."""
    per_class = max(1, n // len(classes))
    known = df.filter(F.col(label).isin(*classes))
    return take_by_hash(known, per_class, seed, key, strata=label)


def hash_split(
    df: DataFrame, key: str, test: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by a hash of the key: two filters, no shuffle, about ``test`` of the rows."""
    # A null key has a hash as well, so every row is in one of the two.
    bucket = hash_number(seeded_hash(F.col(key), seed)) % BUCKETS
    in_test = bucket < round(test * BUCKETS)
    return df.filter(~in_test), df.filter(in_test)

"""Integrity check of a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_number

NULL_MARK = "-"
LENGTH_MARK = "="


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, fingerprint)`` that does not depend on row order or on files.

    Each row is hashed with SHA-256, its cells preceded by their lengths; the first and the second 32
    bits of the hashes are added up apart.
    """

    def cell(name: str):
        text = F.col(name).cast("string")
        sized = F.concat(F.length(text).cast("string"), F.lit(LENGTH_MARK), text)
        return F.coalesce(sized, F.lit(NULL_MARK))

    digest = F.sha2(F.concat(*[cell(c) for c in sorted(df.columns)]), 256)

    def total(first: int):
        # A decimal sum cannot overflow, whatever the number of rows.
        number = hash_number(F.substring(digest, first, 8)).cast("decimal(20,0)")
        return F.coalesce(F.sum(number).cast("string"), F.lit("0"))

    both = F.concat_ws(":", total(1), total(9))
    return df.agg(F.count("*").alias("n_rows"), both.alias("fingerprint"))

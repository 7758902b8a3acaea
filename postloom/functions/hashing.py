"""Hash expressions: ids, and the seeded order that sampling and splitting use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_id(*parts: Column) -> Column:
    """SHA-256 of the joined parts; if any part is null, of the word ``nan``."""
    return F.sha2(F.coalesce(F.concat(*parts), F.lit("nan")), 256)


def seeded_hash(key: Column, seed: int) -> Column:
    """Hex digest that orders rows the same way on any partitioning; a null key counts as empty."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def hash_number(digest: Column, hex_digits: int = 8) -> Column:
    """The leading hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")

"""Raw export to canonical corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..config import SENSITIVE
from ..operators import curate as C


def curate(
    df: DataFrame,
    order_by: Sequence[str],
    lang: str = "es",
    sensitive: Sequence[str] = SENSITIVE,
    threshold: float = 0.95,
    drop: Sequence[str] | None = None,
) -> DataFrame:
    """Drop sparse and personal columns, keep one language, deduplicate, drop retweets, add ids.

    Duplicates go before retweets: a text whose first copy is a retweet is lost. ``order_by`` says
    which copy is first; its columns may be personal, they are dropped after the deduplication.
    ``drop`` names the sparse columns if they are already known, which saves a job.
    """
    sparse = C.sparse_columns(df, threshold) if drop is None else list(drop)
    needed = {"full_text", "lang", "retweeted", "created_at"} & set(sparse)
    if needed:
        raise ValueError(f"columns {sorted(needed)} are almost empty")
    leaving = [c for c in {*sparse, *sensitive} if c not in order_by]
    rows = C.keep_language(df.drop(*leaving), lang)
    first = C.dedup_keep_first(rows, "full_text", order_by)
    kept = C.drop_retweets(first)
    return C.drop_sensitive(C.with_hashed_id(kept), [*sparse, *sensitive])

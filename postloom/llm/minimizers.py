"""Minimisers: consecutive windows that share their smallest item, and how frequent items are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rarity table has 2 ** 16 buckets up to a gigabyte of text, twice as many for each doubling of it, and at
#: most 2 ** 22, four megabytes.
LEVEL_BITS = (16, 22)
LEVEL_BYTES = 1 << 30
_PLACE = np.uint64(0xFFFFFFFF)


def count_levels(docs: DataFrame, text_col: str, hashes: Callable[[pa.Array], Iterator[np.ndarray]]) -> tuple[np.ndarray, int]:
    """How frequent items are, over the whole corpus, and how many there are.

    Items are counted in hash buckets, whose number grows with the corpus. A bucket's level is 0 up to
    twice the mean and one more for each doubling. Windows prefer items of low level, so passages that
    many documents share seldom lend their items to the windows around them. Levels change which
    windows travel together, never which are found equal.
    """
    least, most = LEVEL_BITS
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0
    bits = min(most, least + max(0, n_bytes // LEVEL_BYTES).bit_length())
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in batches:
            for items in hashes(batch.column(0)):
                table += np.bincount((items >> np.uint64(64 - bits)).astype(np.int64), minlength=size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at])], names=["bucket", "n"])

    counted = docs.select(text_col).mapInArrow(run, "bucket int, n bigint")
    got = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size)
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    mean = max(table.mean(), 1.0)
    return np.floor(np.log2(np.maximum(table / mean, 1))).astype(np.uint8), int(table.sum())


def shared_runs(items: np.ndarray, rows: np.ndarray, width: int, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of ``width`` items whose smallest item is the same one.

    ``items`` are hashes; row r has those from ``rows[r]`` to ``rows[r + 1]``. Order is by level, then
    hash, then place, so it depends on a window's content alone. Returns the place of the item, the
    first window's place, and the number of windows, at most ``width``.
    """
    n = len(items)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(len(levels).bit_length() - 1)
    level = levels[(items >> (np.uint64(64) - bits)).astype(np.int64)].astype(np.uint64)
    # The bucket's bits stay out of the order: frequent and rare buckets hold any hash.
    least = (level << np.uint64(56)) | ((items << bits) >> np.uint64(8)) & ~_PLACE | np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n - width + 1], least[width - reach : n - reach + 1])
    place = (least & _PLACE).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    size = np.diff(rows)
    whole = size >= width
    np.add.at(inside, rows[:-1][whole], 1)
    np.add.at(inside, rows[1:][whole] - width + 1, -1)
    window = np.flatnonzero(inside.cumsum()[: len(place)] > 0)
    if not len(window):
        return (np.zeros(0, np.int64),) * 3
    at = place[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(fresh)
    return at[first], window[first], np.diff(np.append(first, len(window)))

"""Importance resampling towards a target distribution of hashed word runs.

1. Runs of words are counted by hash bucket over all documents and over all target texts. Both tables
   have a fixed size; a bucket's gain is the log of its smoothed share in the target over its share in
   the documents.
2. The gains travel as one array; a document's weight is the mean gain of its features, looked up
   there. Gumbel noise from a hash of the seed and the id makes the highest scores a weighted sample
   without replacement.
3. Only the scores, stored as a narrow table, are looked at to draw. A mergeable quantile sketch gives a
   bracket around the cutoff; exact counts outside it prove that the cutoff lies inside, or the
   bracket is widened. The inside is sketched again until it is small, and then alone sorted.
4. The drawn rows are sorted by range, and numbered by the counts of the ranges before them.

Defined cases: null, empty and wordless texts have no features, weight 0 and are never drawn if
``min_words`` is positive; a null id counts as larger than all others, and its noise is that of the
empty string; rows that repeat an id get the same noise, and rows equal in score and id are drawn in
the order in which they were stored; an empty table gives no rows, an empty target gains nothing but
by the documents' own counts. Memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import SLICE_BYTES, fresh_name
from .shared import stored

RUNS = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
NO_ID = 2**63 - 1
#: A sketch's size, the part of all ranks that its bracket leaves on either side of the cutoff (several
#: times its error), and how many rows a bracket may hold to be sorted.
SKETCH = 2048
MARGIN = 0.01
SORTED_ROWS = 65_536
_GROUPS = 512
# Bytes above 0x7F are parts of letters; bytes.lower changes A-Z alone.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def features(text: bytes | None, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the buckets of all runs of 1 to ``runs`` words, part by part of a text."""
    low, at, tail = (text or b"").lower(), 0, []
    while at < len(low):
        gap = _GAP.search(low, at + SLICE_BYTES)
        end = gap.start() if gap else len(low)
        fresh = _WORD.findall(low, at, end)
        at, words, old = end, tail + fresh, len(tail)
        found = list(fresh)
        for n in range(2, runs + 1):
            found += [b" ".join(words[i : i + n]) for i in range(max(0, old - n + 1), len(words) - n + 1)]
        tail = words[len(words) - runs + 1 :] if runs > 1 else []
        yield len(fresh), np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets


def bucket_counts(rows: DataFrame, text_col: str, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket; one small table per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for _, found in features(text.as_py(), runs, buckets):
                    held.append(found)
                    size += len(found)
                if size >= SLICE_BYTES:
                    table += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            table += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at])], names=["bucket", "n"])

    counted = rows.select(text_col).mapInArrow(run, "bucket int, n bigint")
    got = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket at most
    table = np.zeros(buckets, np.int64)
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return table


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the smoothed target share over the smoothed corpus share."""
    size, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def noise(seed: int, name: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(
    docs: DataFrame,
    gains: np.ndarray,
    id_col: str,
    text_col: str,
    columns: Sequence[str],
    names: Sequence[str],
    seed: int = SEED,
    runs: int = RUNS,
) -> DataFrame:
    """``columns`` of each row, then under ``names`` its words, features, weight and score."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    id_name, text_name = fresh_name("id", columns), fresh_name("text", columns)
    rows = docs.select(*columns, F.col(id_col).cast("string").alias(id_name), F.col(text_col).alias(text_name))
    schema = T.StructType(docs.select(*columns).schema.fields + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            *kept, ids, texts = batch.columns
            out = np.zeros((4, batch.num_rows), np.int64)
            for i, (name, text) in enumerate(zip(ids.to_pylist(), texts.cast(pa.large_binary()), strict=True)):
                words = count = total = 0
                for n, found in features(text.as_py(), runs, len(table)):
                    words, count, total = words + n, count + len(found), total + int(table[found].sum())
                weight = total // count if count else 0
                out[:, i] = words, count, weight, weight + noise(seed, name or "")
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, out)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _bounds(rows: DataFrame, value: str, low: float, high: float) -> tuple[int, int]:
    """About the quantiles ``low`` and ``high``: a sketch per task, merged in two steps."""
    group = F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("g")
    parts = rows.select(group, value).groupBy("g").agg(F.kll_sketch_agg_bigint(value, SKETCH).alias("s"))
    ranks = F.array(F.lit(low), F.lit(high))
    whole = parts.agg(F.kll_merge_agg_bigint("s").alias("s"))
    return tuple(whole.select(F.kll_sketch_get_quantile_bigint("s", ranks)).first()[0])


def locate(rows: DataFrame, value: str, wanted: int, total: int, small: int = SORTED_ROWS) -> tuple[int, int]:
    """The ``wanted``-th smallest of ``total`` values (from 1), and how many values are smaller.

    Each round halves at least what lies in the bracket, so a few passes over one column do.
    """
    x, below, inside = F.col(value), 0, rows
    while total > small:
        margin, rank = MARGIN, (wanted - below) / total
        while True:
            if margin < 1:
                low, high = _bounds(inside, value, max(0.0, rank - margin), min(1.0, rank + margin))
            else:
                low, high = inside.agg(F.min(x), F.max(x)).first()
            exact = [x < low, x <= low, x < high, x <= high]
            under, upto_low, under_high, upto = inside.agg(*[F.count_if(c) for c in exact]).first()
            if under < wanted - below <= upto:
                break
            margin *= 4
        if wanted - below <= upto_low:
            return low, below + under
        if wanted - below > under_high:
            return high, below + under_high
        # Ties at the bounds are settled, so the inside holds only ranks near the wanted one.
        inside = inside.filter((x > low) & (x < high))
        below, total = below + upto_low, under_high - upto_low
    found = inside.select(value).orderBy(value).offset(wanted - below - 1).limit(1).first()[0]
    return found, below + inside.filter(x < found).count()


def _drawn(rows: DataFrame, keys: Sequence[str], wanted: int, total: int, small: int) -> Column:
    """Whether a row is among the ``wanted`` smallest of ``total`` by ``keys``, whose last is unique."""
    chosen, tied, at = F.lit(False), F.lit(True), rows
    for key in keys:
        if wanted == total:
            return chosen | tied
        value, below = locate(at, key, wanted, total, small)
        chosen = chosen | (tied & (F.col(key) < value))
        tied = tied & (F.col(key) == value)
        at = at.filter(F.col(key) == value)
        wanted, total = wanted - below, at.count()
    return chosen | tied


def _ranked(rows: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Number rows by ``keys``: sorted by range, each range starts after the counts before it."""
    place = fresh_name("place", rows.columns)
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = stored(ordered.withColumn(place, F.monotonically_increasing_id()), "ordered")
    # The id holds the number of its task from bit 33 on.
    part = F.shiftright(place, 33)
    before, starts = 0, []
    for number, n in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per task
        starts.append((number, before + 1))
        before += n
    part_name, start_name = fresh_name("part", ordered.columns), fresh_name("start", ordered.columns)
    names = rows.sparkSession.createDataFrame(starts, f"{part_name} bigint, {start_name} bigint")
    numbered = ordered.withColumn(part_name, part).join(F.broadcast(names), part_name)
    at = F.col(place).bitwiseAND(F.lit(2**33 - 1))
    return numbered.withColumn(rank, F.col(start_name) + at).drop(place, part_name, start_name)


def draw(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    columns: Sequence[str] = (),
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """``columns`` of every document, and ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Of the documents with ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn:
    those have a rank, 1 for the highest score; ties go to the smaller id. Added names get
    underscores before them where ``columns`` has them.
    """
    kept = [*columns]
    names = []
    for name in ("n_words", "n_features", "weight", "score", "rank", "id_key", "order", "row"):
        names.append(fresh_name(name, [*kept, *names]))
    words, _, _, score, rank, id_key, order, row = names
    gains = bucket_gains(
        bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_text_col, runs, buckets)
    )
    rows = scored(docs.withColumn(id_key, F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))), gains,
                  id_col, text_col, [*kept, id_key], names[:4], seed, runs)
    rows = rows.withColumns({order: -F.col(score), row: F.monotonically_increasing_id()})
    rows = stored(rows, "scored")
    long_enough = rows.filter(F.col(words) >= min_words)
    total = long_enough.count()
    wanted = percent * total // 100
    keys = [order, id_key, row]
    chosen = F.lit(False)
    if wanted:
        chosen = (F.col(words) >= min_words) & _drawn(long_enough.select(keys), keys, wanted, total, sorted_rows)
    ranked = _ranked(rows.filter(chosen), keys, rank) if wanted else rows.limit(0).withColumn(rank, F.lit(0).cast("bigint"))
    rest = rows.filter(~chosen).withColumn(rank, F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(*kept, *names[:5])


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with all their columns and no others."""
    drawn = draw(docs, target, columns=docs.columns, **options)
    rank = drawn.columns[-1]
    return drawn.filter(F.col(rank).isNotNull()).select(docs.columns)


def report(docs: DataFrame, target: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score``, ``rank``."""
    drawn = draw(docs.withColumn(id_col, F.col(id_col).cast("bigint")), target, id_col, columns=[id_col])
    return drawn.select(id_col, "n_features", "weight", "score", "rank")

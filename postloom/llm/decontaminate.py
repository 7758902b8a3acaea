"""Benchmark decontamination: a broadcast set of n-grams of the test items, scanned over the corpus.

Items and documents are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
characters. Every run of ``n`` words of an item is a window; an item of fewer words is one window.
The windows go to every executor as a hash set. Each task hashes the windows of its documents,
looks them up, compares the words of each hit, and marks the words covered.

The documents are read once and never shuffled, so hot sources and hot passages cost nothing more.
The set is broadcast only up to ``max_bytes``: larger benchmarks are cut into blocks of at most
that size, one scan each, whose marks are united per document.

Defined cases: a null or wordless text has no words, hits or items; a null item text gives no
window, a null item id is left out; repeated documents each get their row; repeated items and
equal windows count once per item id; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, PLAIN_WORD, Sums, Words, add_columns, fresh_name, slices

WINDOW = 10
MAX_BYTES = 32 * 1024 * 1024
_FILTER_BITS = 20

FOUND = (
    "n_words:bigint,n_hit:bigint,item_ids:array<string>,"
    "hit_spans:array<struct<start:int,end:int>>"
)


def normal_words(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    for first, data, offsets in slices(texts):
        yield first, Words(LOWER[data], offsets, PLAIN_WORD)


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows with the ids of their items: ``(window, size, items)``.

    One row per window of an item, so the work follows the benchmark; equal windows are united.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, words in normal_words(batch.column(1)):
                found = {"window": [], "size": [], "item": []}
                low = words.data.tobytes()
                spans = list(zip(words.start.tolist(), words.end.tolist(), strict=True))
                for row in range(len(words.count)):
                    own = [low[a:b] for a, b in spans[words.rows[row] : words.rows[row + 1]]]
                    size = min(n, len(own))
                    for i in range(len(own) - size + 1 if own else 0):
                        found["window"].append(b" ".join(own[i : i + size]))
                        found["size"].append(size)
                        found["item"].append(ids[first + row])
                kinds = (pa.binary(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True)], names=list(found)
                )

    rows = items.filter(F.col("item").isNotNull()).mapInArrow(run, "window binary, size int, item string")
    return rows.groupBy("window", "size").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hash_words(words: list[bytes]) -> int:
    data = np.frombuffer(b" ".join(words), np.uint8)
    own = Words(data, np.array([0, len(data)]), PLAIN_WORD)
    return int(Sums(own.hashes(), 1).windows(len(words))[0])


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    """Ranges of set flags."""
    change = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()
    return [{"start": s, "end": e} for s, e in zip(starts, ends, strict=True)]


class WindowSet:
    """Windows by hash, with their words and items, and a small filter before the lookup."""

    def __init__(self, rows: list[tuple[bytes, int, list[str]]]) -> None:
        self.by_hash: dict[int, list[tuple[bytes, list[str]]]] = {}
        self.keys: dict[int, np.ndarray] = {}
        sizes: dict[int, set[int]] = {}
        for window, size, items in rows:
            key = _hash_words(window.split(b" "))
            self.by_hash.setdefault(key, []).append((window, items))
            sizes.setdefault(size, set()).add(key)
        for size, keys in sizes.items():
            flags = np.zeros(1 << _FILTER_BITS, bool)
            flags[np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(64 - _FILTER_BITS)] = True
            self.keys[size] = flags

    def scan(self, texts: pa.Array) -> list[list]:
        counts, hits, items, spans = [], [], [], []
        for _, words in normal_words(texts):
            low, n_words = words.data.tobytes(), len(words.start)
            sums, row_end = Sums(words.hashes(), 1), np.repeat(words.rows[1:], words.count)
            edges, found = np.zeros(n_words + 1, np.int64), [set() for _ in words.count]
            for size, flags in self.keys.items():
                hashes = sums.windows(size)
                maybe = flags[hashes >> np.uint64(64 - _FILTER_BITS)]
                maybe &= np.arange(len(hashes)) + size <= row_end[: len(hashes)]
                places = np.flatnonzero(maybe)
                rows = np.searchsorted(words.rows, places, "right") - 1
                for at, row, key in zip(places.tolist(), rows.tolist(), hashes[places].tolist(), strict=True):
                    if key not in self.by_hash:
                        continue
                    begins, ends = words.start[at : at + size].tolist(), words.end[at : at + size].tolist()
                    own = b" ".join(low[a:b] for a, b in zip(begins, ends, strict=True))
                    for window, ids in self.by_hash[key]:
                        if window == own:
                            edges[at] += 1
                            edges[at + size] -= 1
                            found[row].update(ids)
            hit = edges[:-1].cumsum() > 0
            before = np.concatenate([[0], hit.cumsum()])
            counts += words.count.tolist()
            hits += (before[words.rows[1:]] - before[words.rows[:-1]]).tolist()
            for row, own in enumerate(found):
                items.append(sorted(own))
                spans.append(_runs(hit[words.rows[row] : words.rows[row + 1]]) if own else [])
        return [counts, hits, items, spans]


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The documents with a struct ``contamination`` of the columns in ``FOUND``.

    ``hit_spans`` are ranges of word numbers. The struct's name gets underscores in front if the
    documents have a column of that name; it is the last column.
    """
    name = fresh_name("contamination", docs.columns)
    windows = item_windows(benchmark, item_col, item_text_col, n)
    windows = windows.withColumn("key", F.xxhash64("window"))
    size = F.octet_length("window") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 50) + 200
    blocks = max(1, -(-(windows.agg(F.sum(size.cast("bigint"))).first()[0] or 0) // max_bytes))
    if blocks == 1:
        return _scanned(docs, text_col, name, windows)
    # Marks of each block, then united per row: only ranges and item ids are shuffled.
    row = fresh_name("row_key", docs.columns)
    keyed = docs.withColumn(row, F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)))
    parts = None
    for block in range(blocks):
        part = _scanned(keyed.select(row, text_col), text_col, name, windows.filter(F.pmod("key", F.lit(blocks)) == block))
        part = part.select(row, f"{name}.*")
        parts = part if parts is None else parts.unionByName(part)
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_spans"))))
    # Spans of one document, in order: each word counts once, whatever block covers it.
    words = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s.start, s.end - 1))))
    united = parts.groupBy(row).agg(
        F.max("n_words").alias("n_words"),
        F.size(words).cast("bigint").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        spans.alias("hit_spans"),
    )
    united = united.select(F.col(row), F.struct("n_words", "n_hit", "item_ids", "hit_spans").alias(name))
    return keyed.join(united, row).drop(row)


def _scanned(docs: DataFrame, text_col: str, name: str, windows: DataFrame) -> DataFrame:
    """One scan against windows of a proven size."""
    rows = [(bytes(w), s, list(i)) for w, s, i in windows.select("window", "size", "items").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        held = WindowSet(shared.value)

        def compute(texts: pa.Array) -> list:
            columns = held.scan(texts)
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return [pa.StructArray.from_arrays(arrays, names=["n_words", "n_hit", "item_ids", "hit_spans"])]

        return compute

    return add_columns(docs, text_col, f"`{name}` struct<{FOUND}>", make)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    marked = mark(docs, benchmark, **options)
    return marked.filter(F.col(f"`{marked.columns[-1]}`.n_hit") == 0).select(docs.columns)


def items_digest(ids) -> F.Column:
    return F.sha2(F.array_join(ids, ","), 256)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of words, hit words and items, and a digest of the items."""
    marked = mark(docs.select(id_col, "text"), benchmark)
    found = marked.columns[-1]
    return marked.select(
        id_col,
        f"{found}.n_words",
        f"{found}.n_hit",
        F.size(f"{found}.item_ids").cast("bigint").alias("n_items"),
        items_digest(F.col(f"{found}.item_ids")).alias("items_sha256"),
        (F.col(f"{found}.n_hit") > 0).alias("contaminated"),
    )


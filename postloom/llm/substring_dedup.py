"""Repeated word windows, found exactly with super-k-mers.

Every window of ``window`` words has a minimiser: the run of ``item`` words in it that comes first in
an order by rarity and hash. Consecutive windows with the same minimiser travel as one string, the
super-k-mer, to the bucket of the minimiser's hash. Equal windows have equal minimisers, so they
meet in one bucket, where the windows are sorted, compared word by word, and each is marked
that also starts in a document of a smaller id. The marks go back to the documents.

A task compares the super-k-mers of each block of its texts first: of equal ones only the smallest
document's is sent, the others are marked at once, and their marks are dealt by document. So a passage
in a third of all documents reaches its bucket once per block. Minimisers avoid frequent items,
counted over all documents, so what stands around such a passage spreads over other buckets. Rows that
repeat an id and a text share their marks, so a block sends one of them.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; a null
id is larger than all others and stays null; rows of equal ids never mark each other, and rows that
repeat an id are told apart by 128 bits of their texts' hashes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import NOT_SPACE, SLICE_BYTES, Sums, Words, expand, mixed, slices
from .minimizers import count_levels, shared_runs
from .shared import stored

WINDOW = 13
ITEM = 2
BLOCK_BYTES = 8 << 20
BUCKET_WORDS = 500_000
LEVEL = 3  # of compression
NO_ID = 2**63 - 1
ROW = ["id", "p1", "p2"]
#: Repeated ids up to this number, 8 bytes each, are sent to all tasks.
BROADCAST_IDS = 500_000
MARK = "id bigint, p1 bigint, p2 bigint, start int, windows int"


def _items(item: int):
    def hashes(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in slices(texts):
            yield Sums(Words(data, offsets, NOT_SPACE).hashes(), 1).windows(item)

    return hashes


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``p1`` and ``p2`` name a row: its id, and two hashes of its text.

    An id that one row alone has needs no hashes, so both are 0 there. Repeated ids are counted; up to
    ``BROADCAST_IDS`` of them are sent to the rows, with more all rows get their hashes.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.col(text_col).alias("text"),
    )
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    repeated = stored(repeated, "repeated")
    doubtful = F.lit(True)
    if repeated.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(repeated.withColumn("doubtful", F.lit(True))), "id", "left")
        doubtful = F.col("doubtful").isNotNull()
    parts = {"p1": F.xxhash64("text"), "p2": F.xxhash64(F.lit(1), "text")}
    return rows.select("id", *[F.when(doubtful, h).otherwise(0).alias(p) for p, h in parts.items()], "text")


def _squeezed(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array).tobytes(), "zstd", asbytes=True)


def _restored(blob: bytes, count: int, kind) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), kind)


class Pieces:
    """Super-k-mers of a block: content hash, bucket hash, document, place, windows, bytes."""

    def __init__(self) -> None:
        self.content, self.bucket, self.doc, self.start, self.count, self.text = [], [], [], [], [], []

    def add(self, first_doc: int, data: np.ndarray, offsets: np.ndarray, window: int, item: int, levels: np.ndarray) -> None:
        words = Words(data, offsets, NOT_SPACE)
        sums = Sums(words.hashes(), 1)
        items = sums.windows(item)
        # Items of a row are those that end inside it; the others are cut off by the row's count.
        rows = words.rows
        if not len(items):
            return
        sizes = np.maximum(words.count - item + 1, 0)
        bounds = np.concatenate([[0], sizes.cumsum()])
        inside = np.repeat(rows[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
        at, first, count = shared_runs(items[inside], bounds, window - item + 1, levels)
        if not len(at):
            return
        row = np.searchsorted(bounds, first, "right") - 1
        place = inside[first]
        last = place + count + window - 1
        self.content.append(sums.spans(place, last))
        self.bucket.append(items[inside[at]])
        self.doc.append(row + first_doc)
        self.start.append(place - rows[row])
        self.count.append(count)
        low = data.tobytes()
        self.text += [low[a:b] for a, b in zip(words.start[place].tolist(), words.end[last - 1].tolist(), strict=True)]

    def joined(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in (self.content, self.bucket, self.doc, self.start, self.count)]


def _super_kmers(docs: DataFrame, levels: np.ndarray, buckets: int, window: int, item: int) -> DataFrame:
    """Packed super-k-mers and marks by bucket, one row per block and bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["bucket", "n", "docs", "ids", "p1", "p2", "doc", "start", "count", "done", "size", "text"]
    schema = (
        "bucket int, n int, docs int, ids binary, p1 binary, p2 binary, doc binary, start binary, count binary, "
        "done binary, size bigint, text binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(pieces: Pieces, ids: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> pa.RecordBatch:
            content, bucket, doc, start, count = pieces.joined()
            bucket = (bucket % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start, ids[doc], content))
            same = np.zeros(len(order), bool)
            same[1:] = content[order][1:] == content[order][:-1]
            group = np.flatnonzero(~same)[np.cumsum(~same) - 1]
            # Equal content of a larger id: all its windows are marked, nothing is sent.
            later = np.flatnonzero(ids[doc[order]] > ids[doc[order[group]]])
            texts, done = pieces.text, np.zeros(len(order), bool)
            for i, j in zip(order[later].tolist(), order[group[later]].tolist(), strict=True):
                done[i] = texts[i] == texts[j] or texts[i].split() == texts[j].split()
            by_doc = mixed(ids.astype(np.uint64) ^ p1.astype(np.uint64)) % np.uint64(buckets)
            bucket = np.where(done, by_doc.astype(np.int64)[doc], bucket)
            rows = []
            turn = np.lexsort((start, doc, bucket))
            edges = np.searchsorted(bucket[turn], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = turn[edges[b] : edges[b + 1]]
                used, local = np.unique(doc[own], return_inverse=True)
                text = b"\n".join(texts[i] for i in own[~done[own]].tolist())
                rows.append(
                    (
                        b,
                        len(own),
                        len(used),
                        _squeezed(np.diff(ids[used], prepend=0)),
                        _squeezed(p1[used]),
                        _squeezed(p2[used]),
                        _squeezed(np.diff(local, prepend=0).astype(np.int32)),
                        _squeezed(start[own].astype(np.int32)),
                        _squeezed(count[own].astype(np.uint8)),
                        _squeezed(done[own]),
                        len(text),
                        pa.Codec("zstd", compression_level=LEVEL).compress(text, asbytes=True),
                    )
                )
            kinds = [pa.int32()] * 3 + [pa.binary()] * 7 + [pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        pieces, keys, sent, size, held = Pieces(), [], set(), 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, keys, sent, size, held
            if pieces.content:
                yield packed(pieces, *(np.concatenate(k) for k in zip(*keys, strict=True)))
            pieces, keys, sent, size, held = Pieces(), [], set(), 0, 0

        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(3)]
            for first, data, offsets in slices(batch.column(3)):
                rows = slice(first, first + len(offsets) - 1)
                key = [k[rows] for k in own]
                fresh = np.ones(len(key[0]), bool)
                for i in np.flatnonzero(key[1] | key[2]).tolist():
                    name = tuple(k[i] for k in key)
                    fresh[i] = name not in sent
                    sent.add(name)
                if not fresh.all():
                    sizes = np.diff(offsets)
                    data = data[np.repeat(fresh, sizes)]
                    offsets = np.concatenate([[0], np.where(fresh, sizes, 0).cumsum()])
                pieces.add(held, data, offsets, window, item, shared.value)
                keys.append(key)
                held += len(fresh)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, schema)


def _count_bucket(window: int):
    """Marks of one bucket: ``windows`` has a bit for each marked window from ``start`` on."""

    def marks(table: pa.Table) -> pa.Table:
        ids, p1, p2, start, count, sent, texts = [], [], [], [], [], [], []
        hashes, begin, end, base, waiting = [], [], [], 0, []

        def hash_windows() -> None:
            """Hashes and byte ranges of the windows of the texts that wait."""
            nonlocal base
            text = b"\n".join(texts[-len(waiting) :])
            data = np.frombuffer(text, np.uint8)
            words = Words(data, np.array([0, len(data)]), NOT_SPACE)
            # The words of the super-k-mers stand one after another.
            live = np.concatenate(waiting)
            first = (live + window - 1).cumsum() - (live + window - 1)
            at = expand(first, live)
            if len(at):
                hashes.append(Sums(words.hashes(), 1).windows(window)[at])
                begin.append(words.start[at] + base)
                end.append(words.end[at + window - 1] + base)
            base += len(data) + 1
            waiting.clear()

        for row in table.to_pylist():
            own = _restored(row["ids"], row["docs"], np.int64).cumsum()
            doc = _restored(row["doc"], row["n"], np.int32).cumsum()
            ids.append(own[doc])
            p1.append(_restored(row["p1"], row["docs"], np.int64)[doc])
            p2.append(_restored(row["p2"], row["docs"], np.int64)[doc])
            start.append(_restored(row["start"], row["n"], np.int32))
            count.append(_restored(row["count"], row["n"], np.uint8).astype(np.int64))
            sent.append(~_restored(row["done"], row["n"], bool))
            texts.append(pa.decompress(row["text"], row["size"], "zstd", asbytes=True))
            waiting.append(count[-1][sent[-1]])
            if sum(map(len, texts[-len(waiting) :])) >= SLICE_BYTES:
                hash_windows()
        if waiting:
            hash_windows()
        ids, p1, p2, start, count, sent = (np.concatenate(x) for x in (ids, p1, p2, start, count, sent))
        hashes, begin, end = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.uint64), (begin, np.int64), (end, np.int64)))
        low = b"\n".join(texts)
        texts.clear()
        live = np.where(sent, count, 0)
        which = np.repeat(np.arange(len(ids)), live)
        offset = expand(np.zeros(len(ids)), live)
        order = np.lexsort((ids[which], hashes))
        new = np.ones(len(order), bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        own_id = ids[which[order]]
        later = np.flatnonzero(own_id > own_id[lead])
        bits = np.where(sent, 0, (1 << count) - 1)
        marked = _same_words(low, begin[order], end[order], later, lead, own_id)
        hit = order[marked]
        np.bitwise_or.at(bits, which[hit], 1 << offset[hit])
        kept = np.flatnonzero(bits)
        return pa.table(
            {
                "id": pa.array(ids[kept], pa.int64()),
                "p1": pa.array(p1[kept], pa.int64()),
                "p2": pa.array(p2[kept], pa.int64()),
                "start": pa.array(start[kept], pa.int32()),
                "windows": pa.array(bits[kept], pa.int32()),
            }
        )

    return marks


def _same_words(low: bytes, begin, end, later, lead, ids) -> np.ndarray:
    """Those of ``later`` whose words are those of a smaller document's window of equal hash."""
    out = []
    a, b = begin.tolist(), end.tolist()
    for i, j in zip(later.tolist(), lead[later].tolist(), strict=True):
        own, other = low[a[i] : b[i]], low[a[j] : b[j]]
        if own == other or own.split() == other.split():
            out.append(i)
        else:  # unequal windows of equal hash: look through the whole run
            own = own.split()
            if any(ids[k] < ids[i] and low[a[k] : b[k]].split() == own for k in range(j, i)):
                out.append(i)
    return np.array(out, np.int64)


def _apply(window: int, width: int):
    """Counts and kept texts of ``(id, text, marks)`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            lengths = marks.value_lengths().fill_null(0).to_numpy()
            flat = marks.flatten()
            starts = flat.field(0).to_numpy(zero_copy_only=False)
            bits = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = lengths.cumsum()
            n_words, n_removed, kept = [], [], []
            for text, a, b in zip(batch.column(1).cast(pa.large_binary()), ends - lengths, ends, strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if b > a:
                    row, col = np.nonzero((bits[a:b, None] >> np.arange(width)) & 1)
                    edges = np.zeros(len(words) + 1, np.int64)
                    at = starts[a:b][row] + col
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(edges[:-1].cumsum() == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    item: int = ITEM,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, and the ``kept`` words joined by blanks."""
    if not 0 < item <= window < item + 31:
        raise ValueError("an item must fit into a window, and a window hold up to 31 items")
    rows = keyed(docs, id_col, text_col)
    levels, total = count_levels(rows, "text", _items(item))
    buckets = max(1, -(-total // bucket_words))
    packed = _super_kmers(rows, levels, buckets, window, item)
    marks = packed.groupBy("bucket").applyInArrow(_count_bucket(window), MARK)
    by_row = marks.groupBy(*ROW).agg(F.collect_set(F.struct("start", "windows")).alias("marks"))
    joined = rows.join(by_row, ROW, "left").select("id", "text", "marks")
    out = joined.mapInArrow(
        _apply(window, window - item + 1), "id bigint, n_words bigint, n_removed bigint, kept string"
    )
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts and a digest of the words that stay."""
    kept = remove_repeats(docs, id_col)
    return kept.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

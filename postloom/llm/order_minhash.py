"""Order MinHash fingerprints: similar for texts of small edit distance, not merely of equal content.

A text is cut into words, long words into parts where a hash of the last bytes says so, and every run
of ``k`` words is a k-mer, numbered by its occurrence in the text. Each of ``size`` hash functions
selects the ``keep`` smallest numbered k-mers of the whole text; they are put back into text order and
hashed as a tuple. Two fingerprints' likeness is the share of hash functions with equal tuples.

``by_range`` puts every document beside the next one by id without sorting the table in one task: ids
are cut into ranges at quantiles, each range is one task, and the first document of each range is
sent to the range before it as well. An id that fills several ranges, as a null id may, is cut by the
hashes of its texts. Texts are shuffled once.

Defined cases: null texts are empty; empty texts have equal fingerprints and likeness 1 with each
other, 0 with others; fewer than ``k`` words are one k-mer; null ids come last in the order;
documents of equal id are ordered by their text's ``xxhash64``, then by text; a single document is
followed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import NOT_SPACE, SLICE_BYTES, Sums, Words, byte_sums, mixed

K = 2
KEEP = 2
SIZE = 64
#: Longer words are cut after bytes whose last ``CUT_BYTES`` hash to 0 modulo ``CUT_EVERY``, and at most
#: ``MOST_BYTES`` after the last cut: an edit moves only the cuts near it.
PART_BYTES = 16
CUT_BYTES = 4
CUT_EVERY = 8
MOST_BYTES = 64
RANGE_BYTES = 16 << 20
#: Quantiles that one sketch gives well; with more bytes the ranges grow, and are sorted and streamed.
MAX_RANGES = 20_000
NO_ID = 2**63 - 1
_EMPTY = 0
_LAST = np.uint64(2**64 - 1)


def _parts(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words, long ones cut by content."""
    long = words.end - words.start > PART_BYTES
    if not long.any():
        return words.start, words.end
    code = np.zeros(len(data) - CUT_BYTES, np.uint64)
    for i in range(CUT_BYTES):
        code |= data[i : i + len(code)].astype(np.uint64) << np.uint64(8 * i)
    first = np.flatnonzero(mixed(code) % np.uint64(CUT_EVERY) == 0)
    of = np.searchsorted(words.start, first, "right") - 1
    inside = (of >= 0) & long[of] & (first + CUT_BYTES < words.end[of])
    start = np.union1d(words.start, first[inside] + CUT_BYTES)
    end = np.minimum(np.append(start[1:], len(data)), words.end[np.searchsorted(words.start, start, "right") - 1])
    pieces = np.maximum(1, -(-(end - start) // MOST_BYTES))
    before = pieces.cumsum() - pieces
    step = (np.arange(pieces.sum()) - np.repeat(before, pieces)) * MOST_BYTES
    start = np.repeat(start, pieces) + step
    return start, np.minimum(start + MOST_BYTES, np.repeat(end, pieces))


def _kmers(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of rows, one row after another, and where rows begin."""
    words = Words(data, offsets, NOT_SPACE)
    start, end = _parts(data, words)
    rows = np.searchsorted(start, offsets)
    sums = Sums(byte_sums(data).spans(start, end), 1)
    words_in = np.diff(rows)
    count = np.where(words_in >= k, words_in - k + 1, np.minimum(words_in, 1))
    bounds = np.concatenate([[0], count.cumsum()])
    first = np.repeat(rows[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    return sums.spans(first, np.minimum(first + k, np.repeat(rows[1:], count))), bounds


def _numbered(kmers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with the number of their occurrence in the row."""
    keyed = kmers ^ mixed(rows.astype(np.uint64))
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(order))
    number = np.zeros(len(order), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mixed(kmers + number * np.uint64(0x9E3779B97F4A7C15))


def _functions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed masks and odd factors: ``(x ^ mask) * factor`` orders 64-bit hashes anew for each of them."""
    drawn = np.random.default_rng(11).integers(0, 2**64, (2, size), np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = K, keep: int = KEEP, size: int = SIZE) -> np.ndarray:
    """One row of ``size`` 16-bit signatures per text; a text without words has zeros."""
    kmers, bounds = _kmers(data, offsets, k)
    out = np.full((len(offsets) - 1, size), _EMPTY, np.uint16)
    if not len(kmers):
        return out
    count = np.diff(bounds)
    filled = np.flatnonzero(count)
    begin, row = bounds[filled], np.repeat(np.arange(len(filled)), count[filled])
    numbered, plain = _numbered(kmers, row), mixed(kmers)
    weight = np.array([pow(0xD1342543DE82EF95, i + 1, 2**64) for i in range(keep)], np.uint64)
    for at, (mask, factor) in enumerate(zip(*_functions(size), strict=True)):
        order = (numbered ^ mask) * factor
        taken = np.empty((keep, len(filled)), np.int64)
        for i in range(keep):
            least = np.minimum.reduceat(order, begin)
            place = np.flatnonzero(order == least[row])
            if len(place) > len(filled):  # equal hashes in a row: the first one
                place = place[np.unique(row[place], return_index=True)[1]]
            taken[i] = place
            order[place] = _LAST
        # Back to text order; rows with fewer k-mers than ``keep`` have one several times, which counts once.
        taken.sort(axis=0)
        tuples = plain[taken] * weight[:, None]
        tuples[1:][taken[1:] == taken[:-1]] = 0
        signature = (mixed(tuples.sum(axis=0, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
        out[filled, at] = np.maximum(signature, 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of hash functions with equal signatures, row by row; two texts without words are equal."""
    filled = ((a != _EMPTY) | (b != _EMPTY)).sum(1)
    same = ((a == b) & (a != _EMPTY)).sum(1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def shown(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def _of(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of texts, a slice at a time."""
    parts, at = [], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SLICE_BYTES):
            size += len(texts[upto])
            upto += 1
        own = texts[at:upto]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
        parts.append(fingerprints(np.frombuffer(b"".join(own), np.uint8), offsets))
        at = upto
    return np.concatenate(parts) if parts else np.zeros((0, SIZE), np.uint16)


class Ranges:
    """Ranges of rows ordered by ``(id, hash)``; an id that is several cuts at once is cut by its hashes."""

    def __init__(self, cuts: list[int]) -> None:
        self.ids, self.times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.before = np.concatenate([[0], self.times.cumsum()])

    def __len__(self) -> int:
        return int(self.before[-1]) + 1

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range of each row: as many cuts lie before it."""
        at = np.searchsorted(self.ids, ids, "left")
        out = self.before[at].copy()
        for cut in np.unique(at[at < len(self.ids)]):
            times = int(self.times[cut])
            if times > 1:
                own = (at == cut) & (ids == self.ids[cut])
                edges = [-(2**63) + 2**64 * i // times for i in range(1, times)]
                out[own] += np.searchsorted(np.array(edges, np.int64), hashes[own], "right")
        return out.astype(np.int32)


def by_range(docs: DataFrame, id_col: str, text_col: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(id, text, ahead)`` in ranges of ids, one task each, sorted; rows with ``ahead`` are copies
    of the document that follows the range's last one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(1, -(-total // range_bytes)), MAX_RANGES)
    cuts = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = rows.agg(F.percentile_approx("id", shares, 100 * ranges)).first()[0] or []
    edges = rows.sparkSession.sparkContext.broadcast(cuts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ranges(edges.value)
        for batch in batches:
            at = known.of(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["id", "hash", "range"])

    keys = rows.select("id", "hash").mapInArrow(number, "id bigint, hash bigint, range int")
    heads = keys.groupBy("range").agg(F.min(F.struct("id", "hash")).alias("head")).orderBy("range").collect()  # one row per range
    before = {(h["head"]["id"], h["head"]["hash"]): heads[i - 1]["range"] for i, h in enumerate(heads)}  # the first follows the last
    known_heads = rows.sparkSession.sparkContext.broadcast(before)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads_of = Ranges(edges.value), known_heads.value
        head_hashes = np.array(sorted(h for _, h in heads_of), np.int64)
        names = ["id", "hash", "text", "range", "ahead"]
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = known.of(ids, hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.zeros(len(ids), bool))], names=names)
            maybe = np.flatnonzero(np.isin(hashes, head_hashes))
            head = [i for i in maybe.tolist() if (int(ids[i]), int(hashes[i])) in heads_of]
            if head:
                to = [heads_of[int(ids[i]), int(hashes[i])] for i in head]
                copies = (c.take(pa.array(head)) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([*copies, pa.array(to, pa.int32()), pa.array(np.ones(len(head), bool))], names=names)

    dealt = rows.mapInArrow(deal, "id bigint, hash bigint, text string, range int, ahead boolean")
    placed = dealt.repartitionById(len(Ranges(cuts)), F.col("range"))
    return placed.sortWithinPartitions("ahead", "id", "hash", "text").select("id", "text", "ahead")


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by as much of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and two likenesses."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
            ids = [p[0] for p in pairs]
            texts = [p[1] for p in pairs]
            changed = [edited(t, f).encode() for _, t, f in pairs]
            own = _of([t.encode() for t in texts] + [pairs[-1][2].encode()])
            other = _of(changed)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                pa.array(shown(own[:-1])),
                pa.array(shown(other)),
                pa.array(likeness(own[:-1], other)),
                pa.array(likeness(own[:-1], own[1:])),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held: tuple[int, str] | None = None
        pairs, size, ended = [], 0, False
        for batch in batches:
            for at in range(batch.num_rows):
                if ended:
                    break
                row = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                ended = batch.column(2)[at].as_py()
                if held is not None:
                    pairs.append((*held, row[1]))
                    size += len(row[1])
                held = row
                if size >= 4 * SLICE_BYTES or len(pairs) >= 2000:
                    yield judged(pairs)
                    pairs, size = [], 0
        if pairs:
            yield judged(pairs)

    ddl = (
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    found = by_range(docs, id_col, text_col).mapInArrow(run, ddl)
    return found.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), *names[1:])

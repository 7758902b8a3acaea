"""Byte strings that occur more than once, by suffix arrays over shards.

1. Every 400-byte window has an anchor, the 160-byte run in it that comes first by rarity and hash.
   Runs of windows with the same anchor give one small row: anchor hash, document, place. Equal
   windows have equal anchors, so only anchors that occur twice can hold repeats.
2. The segments around those anchors go to the shard of the anchor's hash. A shard sorts the suffixes
   of its segments by induced sorting and takes the common prefix of neighbours in text order:
   a window that shares 400 bytes with a neighbour is repeated.
3. The marks go back to the documents, which lose every byte that a marked window covers.

Equal segments are united in each block of a task and again in the shard: all their windows are
repeated, and only one of them is sorted. A passage that makes up a third of all rows thus costs
one segment per block, and since anchors avoid frequent runs, what stands around it spreads out.

Defined cases: null and empty texts have no bytes; texts below 400 bytes lose nothing; strings never
reach over the end of a text; all occurrences are removed, in one document or in many; rows
that repeat an id and a text count as occurrences of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import byte_sums, expand, slices
from .minimizers import count_levels, shared_runs
from .shared import stored
from .substring_dedup import MARK, NO_ID, ROW, keyed
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 400
ANCHOR = 160
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
_SEPARATOR = b"\xff"  # in no UTF-8 text


def _items(anchor: int):
    def hashes(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, data, _ in slices(texts):
            yield byte_sums(data).windows(anchor)

    return hashes


def anchors(rows: DataFrame, levels: np.ndarray, length: int, anchor: int) -> DataFrame:
    """``(anchor, id, p1, p2, start, windows)``: runs of windows of ``rows`` with one anchor."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            for first, data, offsets in slices(batch.column(3)):
                items = byte_sums(data).windows(anchor)
                sizes = np.maximum(np.diff(offsets) - anchor + 1, 0)
                bounds = np.concatenate([[0], sizes.cumsum()])
                inside = expand(offsets[:-1], sizes)
                at, window, count = shared_runs(items[inside], bounds, length - anchor + 1, shared.value)
                row = np.searchsorted(bounds, window, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(items[inside[at]].view(np.int64) if len(at) else np.zeros(0, np.int64)),
                        *(pa.array(k[first + row]) for k in keys),
                        pa.array(window - bounds[row], pa.int32()),
                        pa.array(count, pa.int32()),
                    ],
                    names=["anchor", *ROW, "start", "windows"],
                )

    return rows.mapInArrow(run, f"anchor bigint, {MARK}")


def _segments(joined: DataFrame, shards: int, length: int) -> DataFrame:
    """Segments and ready marks of ``(id, p1, p2, text, runs)`` rows, by shard.

    ``owned`` is false for the one copy of a segment whose marks are already made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "anchor", *ROW, "start", "windows", "owned", "segment"]
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        held: dict[bytes, list[tuple]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out = []
            for segment, members in held.items():
                key = members[0][0]
                shard = key % shards
                if len(members) > 1:
                    # Repeated: marked here, and dealt out by document, as they may be many.
                    out += [((m[1] ^ m[2]) % shards, None, *m[1:], True, None) for m in members]
                    out.append((shard, key, *members[0][1:], False, segment))
                else:
                    out.append((shard, *members[0], True, segment))
            held.clear()
            columns = zip(*out, strict=True) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            texts = batch.column(3).cast(pa.large_binary())
            for at in range(batch.num_rows):
                text = texts[at].as_py() or b""
                own = [batch.column(i)[at].as_py() for i in range(3)]
                for r in batch.column(4)[at].as_py():
                    segment = text[r["start"] : r["start"] + r["windows"] + length - 1]
                    members = held.setdefault(segment, [])
                    members.append((r["anchor"], *own, r["start"], r["windows"]))
                    size += len(segment)
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        yield flush()

    return joined.mapInArrow(
        run, f"shard int, anchor bigint, {MARK}, owned boolean, segment binary"
    )


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of these distinct segments, flags of the windows that occur in another place."""
    data = _SEPARATOR.join(segments)
    text = np.frombuffer(data, np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    begin = np.concatenate([[0], (sizes + 1).cumsum()])[:-1]
    before, prefix = permuted_prefixes(text, suffix_array(text), length)
    whole = np.zeros(len(text), bool)
    whole[expand(begin, np.maximum(sizes - length + 1, 0))] = True
    hit = np.zeros(len(text), bool)
    for i in np.flatnonzero((prefix >= length) & whole).tolist():
        j = int(before[i])
        if data[i : i + length] == data[j : j + length]:
            hit[i] = hit[j] = True
    return [hit[b : b + s] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _shard(length: int):
    def marks(table: pa.Table) -> pa.Table:
        out = {name: [] for name in (*ROW, "start", "windows")}

        def add(member: tuple, start: int, windows: int) -> None:
            for name, value in zip(out, (*member[:3], member[3] + start, windows), strict=True):
                out[name].append(value)

        members: dict[bytes, list[tuple]] = {}
        contents: dict[int, set[bytes]] = {}
        columns = [table.column(n).to_pylist() for n in ("anchor", *ROW, "start", "windows", "owned", "segment")]
        for anchor, *row, windows, owned, segment in zip(*columns, strict=True):
            if segment is None:
                add(tuple(row), 0, windows)
                continue
            members.setdefault(segment, []).append((*row, windows, owned))
            contents.setdefault(anchor, set()).add(segment)
        hit: dict[bytes, np.ndarray] = {}
        mixed = sorted(s for group in contents.values() if len(group) > 1 for s in group)
        if mixed:
            hit = dict(zip(mixed, repeated_windows(mixed, length), strict=True))
        for segment, own in members.items():
            if len(own) > 1 or not own[0][-1]:
                runs = [(0, own[0][-2])]
            elif segment in hit:
                change = np.diff(np.concatenate([[0], hit[segment], [0]]).astype(np.int8))
                first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
                runs = list(zip(first.tolist(), (last - first).tolist(), strict=True))
            else:
                continue
            for member in own:
                if member[-1]:
                    for start, windows in runs:
                        add(member, start, windows)
        return pa.table({n: pa.array(v, pa.int64() if n in ROW else pa.int32()) for n, v in out.items()})

    return marks


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            sizes = marks.value_lengths().fill_null(0).to_numpy()
            flat = marks.flatten()
            starts = flat.field(0).to_numpy(zero_copy_only=False)
            windows = flat.field(1).to_numpy(zero_copy_only=False)
            ends = sizes.cumsum()
            found = {"n_bytes": [], "n_removed": [], "n_spans": []}
            kept = []
            for text, a, b in zip(batch.column(1).cast(pa.large_binary()), ends - sizes, ends, strict=True):
                text = text.as_py() or b""
                whole, spans = len(text), 0
                if b > a:
                    edges = np.zeros(whole + 1, np.int64)
                    np.add.at(edges, starts[a:b], 1)
                    np.add.at(edges, starts[a:b] + windows[a:b] + length - 1, -1)
                    gone = edges[:-1].cumsum() > 0
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone]).astype(np.int8)) == 1))
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for value, column in zip((whole, whole - len(text), spans), found.values(), strict=True):
                    column.append(value)
                kept.append(text)
            columns = [batch.column(0), *(pa.array(v, pa.int64()) for v in found.values()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *found, "kept"])

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, and the ``kept`` bytes."""
    rows = keyed(docs, id_col, text_col)
    levels, _ = count_levels(rows, "text", _items(anchor))
    found = stored(anchors(rows, levels, length, anchor), "anchors")
    # Stored, so that adaptive execution can split the rows of an anchor that very many documents have.
    twice = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "twice")
    runs = stored(found.join(twice, "anchor"), "anchors")
    total = runs.agg(F.sum(F.col("windows") + length - 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    by_row = runs.groupBy(*ROW).agg(F.collect_set(F.struct("anchor", "start", "windows")).alias("runs"))
    joined = rows.join(by_row, ROW).select(*ROW, "text", "runs")
    marks = _segments(joined, shards, length).groupBy("shard").applyInArrow(_shard(length), MARK)
    by_row = marks.groupBy(*ROW).agg(F.collect_set(F.struct("start", "windows")).alias("marks"))
    joined = rows.join(by_row, ROW, "left").select("id", "text", "marks")
    out = joined.mapInArrow(_apply(length), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept"
    )


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts and a digest of the bytes that stay."""
    kept = remove_repeats(docs, id_col)
    return kept.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

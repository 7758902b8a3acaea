"""Cost-balanced packing of tokenised documents into training sequences.

Each task tokenises its documents and packs them in blocks of about ``block_tokens`` tokens. A block
of T tokens gets T // capacity sequences of full capacity, and for the rest one sequence for each
power of two in it, so no sequence needs padding. A document longer than a sequence first gives
whole sequences; then the documents, in descending length, each go to the sequence of lowest
cost that still has room for it. The cost of a document piece in a sequence is estimated as
``linear * length + quadratic * length ** 2``, what attention within the piece takes. A document
that fits nowhere whole is cut: it fills the sequence with the most room, and its rest goes on.

No row is shuffled: blocks lie within one task's input, and each task numbers its own sequences.
Memory is bounded by the block (two bytes a token) and the longest document.

Defined cases: null or empty texts hold the end token alone; repeated documents are packed each;
an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .flat import expand, process_pool

CAPACITY = 4096
END_TOKEN = 2
BLOCK_TOKENS = 1_000_000
KEPT_PIECES = 500_000
_SEQUENCES_PER_TASK = 1 << 32
_ENCODED_AT_ONCE = 4096
#: Letters, digits and blanks among the first 256 characters, after lower-casing.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_BLANKS = "\t\n\v\f\r \u0085\u00a0"
#: The pieces into which the vocabulary's splitter cuts a text of these characters.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """Ids of texts, equal to the tokenizer's own, with its work done once per distinct piece.

    Texts are cut at the added tokens first, as the tokenizer does. The vocabulary cuts a text into pieces before it merges, so the ids of a text are those of its
    pieces, one after another. Texts of the first 256 characters are cut here; others between
    blanks, which is a coarser cut. Kept pieces are dropped when ``kept`` is reached.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        self.at_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added)))})")
        self.kept = kept
        vocabulary = self.model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """Plain pieces are encoded as one text, as each is one word there and its last token closes
        it; others, which may hold several words, one by one, at several times the cost."""
        ids, length = [], []
        for at in range(0, len(plain), _ENCODED_AT_ONCE):
            joined = self.model.encode(" ".join(plain[at : at + _ENCODED_AT_ONCE]), add_special_tokens=False)
            own = np.array(joined.ids, np.int64)
            ids += joined.ids
            length += np.diff(np.flatnonzero(self.closes[own]), prepend=-1).tolist()
        for at in range(0, len(other), _ENCODED_AT_ONCE):
            for x in self.model.encode_batch_fast(other[at : at + _ENCODED_AT_ONCE], add_special_tokens=False):
                own = x.ids
                length.append(len(own))
                ids += own
        length = np.array(length, np.int64)
        first = len(self.start)
        self.place.update(zip(plain + other, range(first, first + len(length)), strict=True))
        self.start = np.append(self.start, len(self.ids) + length.cumsum() - length)
        self.length = np.append(self.length, length)
        self.ids = np.append(self.ids, np.array(ids, np.uint16))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """One array of ids per text, the end token last."""
        if len(self.place) > self.kept:
            self._clear()
        cut, place, plain, other = [], self.place, set(), set()
        for text in texts:
            text = text or ""
            cut.append([])
            for part in self.at_added.split(text) if any(t in text for t in self.added) else [text]:
                if part in self.added:
                    pieces = [part]
                    other |= {part}.difference(place)
                elif _is_latin(part):
                    # Lower-casing and composing cannot interact in this range of characters.
                    pieces = _PIECES.findall(part.lower())
                    plain |= set(pieces).difference(place)
                else:
                    pieces = part.replace("\n", " ").split(" ")
                    other |= set(pieces).difference(place)
                cut[-1] += pieces
        if plain or other:
            self._learn(sorted(plain), sorted(other - plain))
        for pieces in cut:
            at = np.array(list(map(place.__getitem__, pieces)), np.int64)
            ids = self.ids[expand(self.start[at], self.length[at])]
            yield np.append(ids, np.uint16(END_TOKEN))


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, as its words serve all tasks there."""
    pool = process_pool()
    if path not in pool:
        pool[path] = WordTokenizer(path)
    return pool[path]


def plan_sequences(
    lengths: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 4096
) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` for documents of these lengths."""
    total, pieces = int(lengths.sum()), []
    rooms = [capacity] * (total // capacity)
    rooms += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    room = np.array(rooms, np.int64)
    size, cost, taken = room.copy(), np.zeros(len(room)), 0
    waiting: list[tuple[int, int, int]] = []
    for doc, length in enumerate(lengths.tolist()):
        whole = length // capacity
        for i in range(whole):
            pieces.append((doc, i * capacity, capacity, taken, 0))
            taken += 1
        if length % capacity:
            waiting.append((-(length % capacity), doc, whole * capacity))
    room[:taken] = 0
    heapq.heapify(waiting)
    while waiting:
        length, doc, start = heapq.heappop(waiting)
        length = -length
        fits = np.flatnonzero(room >= length)
        if len(fits):
            at, part = int(fits[np.argmin(cost[fits])]), length
        else:
            at = int(room.argmax())
            part = int(room[at])
            heapq.heappush(waiting, (part - length, doc, start + part))
        pieces.append((doc, start, part, at, int(size[at] - room[at])))
        room[at] -= part
        cost[at] += linear * part + quadratic * part * part
    return pieces


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of a document, as placed in a sequence; ``ids`` has its tokens.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``, ``ids``. A sequence holds its pieces from offset 0 on without gaps.
    """
    chosen = docs.select(id_col, text_col)
    kind = chosen.schema[0].dataType.simpleString()
    columns = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = tokenizer(vocabulary), TaskContext.get().partitionId()
        number, held, keys, size = task * _SEQUENCES_PER_TASK, [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            pieces = plan_sequences(lengths, capacity)
            parts = [held[d][s : s + n].astype("<u4") for d, s, n, _, _ in pieces]
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(keys).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                    pa.array(lengths[doc]),
                    pa.array(number + sequence),
                    pa.array(offset),
                    pa.array([x.tobytes() for x in parts], pa.binary()),
                ],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            number += int(sequence.max()) + 1
            held.clear()
            keys.clear()
            return batch

        for batch in batches:
            step = 64
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                keys.append(some.column(0))
                for ids in words.encode(some.column(1).to_pylist()):
                    held.append(ids)
                    size += len(ids)
                if size >= block_tokens:
                    yield packed()
                    size = 0
        if held:
            yield packed()

    return chosen.mapInArrow(run, f"`{id_col}` {kind}, {columns}, ids binary")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def report(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per piece, without its tokens."""
    return pack(docs, vocabulary or vocabulary_path(), id_col).drop("ids")

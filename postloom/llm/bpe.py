"""Byte-pair encoding and decoding with an index of pair occurrences.

A block of a partition is cut into pieces as the vocabulary's splitter does. All pieces that the worker
does not know yet stand in one chain of symbols, and every pair with a rank is mapped to all its
positions there. Ranks that have positions are taken in ascending order: each position that still
holds the pair is merged, and the two pairs that arise around it join the lists of their ranks. A
vocabulary makes a token before it uses it, which is checked, so new pairs always have later ranks, and
working through a whole block by rank gives what working through each piece alone would.

Pieces are kept by worker process (``KEPT_PIECES`` at most, then all are forgotten), so a word is merged
once and not once per occurrence. No row is shuffled, and memory is bounded by a slice of texts.

Defined cases: null and empty texts have no ids and decode to the empty text; the strings of added
tokens have their own ids; repeated rows are encoded each; an empty table gives no rows. Null lists of
ids decode to the empty text, null and unknown ids in them are left out.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import add_columns, expand, fresh_name, process_pool
from .packing import _PIECES as LATIN_PIECES
from .packing import _is_latin, vocabulary_path

KEPT_PIECES = 300_000
SLICE_CHARS = 1 << 20
_NONE = -1


def byte_units() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Symbols, ranked pairs and added tokens of a vocabulary file with word ends."""

    def __init__(self, path: str) -> None:
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, steps = parts["model"], parts["pre_tokenizer"].get("pretokenizers", [])
        end = model.get("end_of_word_suffix")
        wrong = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if wrong or not end or parts.get("decoder") or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: only byte-level merges with word ends and plain decoding are supported")
        if parts.get("truncation") or parts.get("padding") or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError(f"{path}: unsupported settings of the splitter, truncation or padding")
        added = parts["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: only added tokens that are matched as they stand are supported")
        ids = model["vocab"]
        units = byte_units()
        self.inner = np.array([ids[u] for u in units], np.int64)
        self.last = np.array([ids[u + end] for u in units], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = [ids[a] for a, _ in pairs]
        self.right = [ids[b] for _, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        known = {*self.inner.tolist(), *self.last.tolist()}
        for a, b, made in zip(self.left, self.right, self.made, strict=True):
            if a not in known or b not in known or made in known:
                raise ValueError(f"{path}: a merge uses a token that no earlier merge makes, or makes one twice")
            known.add(made)
        self.base = max(known) + 1
        self.rank = {a * self.base + b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.added = {t["content"]: t["id"] for t in added}
        self.at_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if added else None
        self.token = {i: w for w, i in ids.items()} | {i: w for w, i in self.added.items()}
        # Other scripts are normalised and split by the vocabulary's own rules, word by word.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)

    def pieces_of(self, part: str) -> list[str]:
        if self.normalizer is not None:
            part = self.normalizer.normalize_str(part)
        return [piece for piece, _ in self.splitter.pre_tokenize_str(part)]


def merge_by_rank(words: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after another, and the number of ids of each; pieces are not empty."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    # One symbol that belongs to no pair stands before each piece, and one at the end.
    ends = sizes.cumsum()
    place = np.arange(len(data)) + np.repeat(np.arange(len(pieces)), sizes) + 1
    start = np.full(len(data) + len(pieces) + 1, _NONE, np.int64)
    start[place] = words.inner[data]
    start[place[ends - 1]] = words.last[data[ends - 1]]
    pairs = start[:-1] * words.base + start[1:]
    at = np.minimum(np.searchsorted(words.keys, pairs), len(words.keys) - 1)
    found = np.flatnonzero((words.keys[at] == pairs) & (start[:-1] >= 0) & (start[1:] >= 0))
    ranks = words.ranks[at[found]]
    order = np.argsort(ranks, kind="stable")
    active, first = np.unique(ranks[order], return_index=True)
    lists = np.split(found[order], first[1:])
    index = {r: p.tolist() for r, p in zip(active.tolist(), lists, strict=True)}

    symbol, n = start.tolist(), len(start)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    base, rank_of = words.base, words.rank
    heap = active.tolist()  # sorted, so it is a heap
    while heap:
        rank = heapq.heappop(heap)
        left, right, made = words.left[rank], words.right[rank], words.made[rank]
        for i in sorted(index.pop(rank)):
            if symbol[i] != left:
                continue
            j = after[i]
            if symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, _NONE
            k, p = after[j], before[i]
            after[i], before[k] = k, i
            for a, x, y in ((p, symbol[p], made), (i, made, symbol[k])):
                if x >= 0 and y >= 0:
                    new = rank_of.get(x * base + y)
                    if new is not None:
                        if new in index:
                            index[new].append(a)
                        else:
                            index[new] = [a]
                            heapq.heappush(heap, new)
    left_over = np.array(symbol, np.int64)
    alive = left_over >= 0
    bounds = np.concatenate([[0], ends + np.arange(1, len(pieces) + 1)])
    count = np.add.reduceat(alive, bounds[:-1]) if len(pieces) else np.zeros(0, np.int64)
    return left_over[alive], count


class Encoder:
    """Ids of texts; pieces that were merged before are looked up."""

    def __init__(self, words: Vocabulary, kept: int = KEPT_PIECES) -> None:
        self.words, self.kept = words, kept
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.cut: dict[str, list[str]] = {}
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        # Added tokens are pieces with one id.
        for text, i in self.words.added.items():
            self._keep([text], np.array([i]), np.ones(1, np.int64))

    def _keep(self, pieces: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        first = len(self.start)
        self.place.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.start = np.append(self.start, len(self.ids) + count.cumsum() - count)
        self.count = np.append(self.count, count)
        self.ids = np.append(self.ids, ids.astype(np.int32))

    def _pieces(self, part: str) -> list[str]:
        if _is_latin(part):
            return LATIN_PIECES.findall(part.lower())
        out = []
        # A blank ends every piece, and no letter combines with one.
        for word in part.replace("\n", " ").split(" "):
            if word not in self.cut:
                self.cut[word] = self.words.pieces_of(word)
            out += self.cut[word]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.place) + len(self.cut) > self.kept:
            self._forget()
        cut, added, splits = [], self.words.added, self.words.at_added
        for text in texts:
            text, own = text or "", []
            for part in splits.split(text) if any(t in text for t in added) else [text]:
                own += [part] if part in added else self._pieces(part)
            cut.append(own)
        fresh = sorted(set().union(*cut).difference(self.place))
        if fresh:
            self._keep(fresh, *merge_by_rank(self.words, [p.encode() for p in fresh]))
        out, find = [], self.place.__getitem__
        for own in cut:
            at = np.fromiter(map(find, own), np.int64, len(own))
            out.append(self.ids[expand(self.start[at], self.count[at])])
        return out


def encoder(path: str) -> Encoder:
    """One per worker process, as its pieces serve all tasks there."""
    pool = process_pool()
    if ("bpe", path) not in pool:
        pool["bpe", path] = Encoder(Vocabulary(path))
    return pool["bpe", path]


def _groups(batch: pa.RecordBatch, place: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows whose texts have about ``SLICE_CHARS`` characters together, and these texts."""
    held, size, first = [], 0, 0
    for text in batch.column(place):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= SLICE_CHARS:
            yield batch.slice(first, len(held)), held
            first, held, size = first + len(held), [], 0
    if held:
        yield batch.slice(first, len(held)), held


def _joined(words: Vocabulary, ids: np.ndarray) -> str:
    token = words.token
    return " ".join([token[i] for i in ids.tolist() if i in token])


def encode(
    docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids", decoded: str | None = None, keep_text: bool = True
) -> DataFrame:
    """Add the ids of each text, an ``array<int>``; a clashing name gets underscores before it.

    With ``decoded`` a column of that name has what the ids decode to, made from them in the same
    pass; without ``keep_text`` the text column does not leave it.
    """
    place = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != place]
    fields = [docs.schema.fields[i] for i in kept]
    names = [f.name for f in fields]
    added = [T.StructField(fresh_name(out, names), T.ArrayType(T.IntegerType()))]
    if decoded is not None:
        added.append(T.StructField(fresh_name(decoded, [*names, added[0].name]), T.StringType()))
    schema = T.StructType(fields + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            for rows, texts in _groups(batch, place):
                found = words.encode(texts)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
                new = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))]
                if decoded is not None:
                    new.append(pa.array([_joined(words.words, ids) for ids in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each list of ids: their tokens, added ones too, joined by blanks."""

    def make():
        words = encoder(vocabulary).words

        def compute(lists: pa.Array) -> list[pa.Array]:
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = lists.value_lengths().fill_null(0).to_numpy().cumsum().tolist()
            return [pa.array([_joined(words, flat[a:b]) for a, b in zip([0, *ends], ends)], pa.string())]

        return compute

    return add_columns(docs, ids_col, f"`{fresh_name(out, docs.columns)}` string", make)


def report(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_tokens``, and digests of its ids and of the text they decode to."""
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = encode(rows, path, decoded="decoded", keep_text=False)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

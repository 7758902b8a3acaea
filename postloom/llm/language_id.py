"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of ``slots`` entries serves all languages: entry s holds a bit mask, one bit per language.
Training counts, over all labelled rows, how often each language's n-grams fall on each slot; a
language's bit is set where its rate is at least ``share`` of the highest rate of any language
there. Looking an n-gram up takes the AND of its slots' masks, which is the set of all languages
that contain it. A text counts, per language, its n-grams with that bit (a popcount along the
language's slice), takes off what the filter's fill alone would give, and the largest count decides.

Counts are summed per task into dense tables and combine before their shuffle, whatever the number
of rows of a language. The filter is broadcast; its size is ``slots`` times the mask, never the data.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing was learned; rows without a language teach nothing; texts shorter than an n-gram are padded
with blanks; ties go to the language that sorts first; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, PLAIN_WORD, add_columns, byte_class, fresh_name, mixed, slices
from .shared import stored

GRAM = 4
SLOTS = 1 << 19
SHARE = 0.5
MIN_COUNT = 3
UNKNOWN = "und"
_LANGUAGES_PER_WORD = 63
_TABLES_HELD = 16
_LETTER = PLAIN_WORD & ~byte_class((0x30, 0x39))
_ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))


def grams(data: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two slots of every n-gram with a letter, and the n-gram numbers at which rows begin.

    Bytes outside words are blanks; every row stands between blanks.
    """
    low, count = LOWER[data], len(offsets) - 1
    flags = _LETTER[low]
    padded = np.full(len(data) + GRAM * (count + 1), 0x20, np.uint8)
    letter = np.zeros(len(padded), bool)
    place = np.arange(len(data)) + np.repeat(np.arange(1, count + 1) * GRAM, np.diff(offsets))
    padded[place] = np.where(flags, low, 0x20)
    letter[place] = flags
    n = len(padded) - GRAM + 1
    code = np.zeros(n, np.uint64)
    some = np.zeros(n, bool)
    for i in range(GRAM):
        code |= padded[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        some |= letter[i : i + n]
    at = np.flatnonzero(some)
    rows = np.searchsorted(at, offsets + GRAM * np.arange(count + 1) + 1)
    key = mixed(code[at])
    return (key % np.uint64(slots)).astype(np.int64), ((key >> np.uint64(32)) % np.uint64(slots)).astype(np.int64), rows


def slot_counts(rows: DataFrame, lang_col: str, text_col: str, slots: int) -> DataFrame:
    """``(lang, slot, n)``: n-grams of each language on each slot, of all rows; slot -1 has the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, table in held.items():
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(at) + 1), pa.string()),
                        pa.array(np.append(at, -1), pa.int32()),
                        pa.array(np.append(table[at], table.sum() // 2), pa.int64()),
                    ],
                    names=["lang", "slot", "n"],
                )
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, data, offsets in slices(batch.column(1)):
                a, b, bounds = grams(data, offsets, slots)
                own = langs[first : first + len(offsets) - 1]
                each = np.repeat(np.unique(own, return_inverse=True)[1], np.diff(bounds))
                for number, lang in enumerate(np.unique(own)):
                    if lang not in held and len(held) >= _TABLES_HELD:
                        yield from emptied()
                    table = held.setdefault(lang, np.zeros(slots, np.int64))
                    mine = each == number
                    table += np.bincount(a[mine], minlength=slots)
                    table += np.bincount(b[mine], minlength=slots)
        yield from emptied()

    counted = rows.select(F.col(lang_col).cast("string"), text_col).mapInArrow(run, "lang string, slot int, n bigint")
    return counted.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass
class LanguageFilter:
    """Masks of the slots (a column of 63 languages each) and the languages of the bits."""

    languages: list[str]
    masks: np.ndarray
    slots: int

    def false_rates(self) -> np.ndarray:
        """Chance that an n-gram of no language passes, per language: the fill squared."""
        fill = [
            ((self.masks[:, i // _LANGUAGES_PER_WORD] >> (i % _LANGUAGES_PER_WORD)) & 1).mean()
            for i in range(len(self.languages))
        ]
        return np.array(fill) ** 2

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected share of n-grams per row and language."""
        a, b, bounds = grams(data, offsets, self.slots)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        size = np.maximum(np.diff(bounds), 1)
        rates = self.false_rates()
        for word in range(self.masks.shape[1]):
            column = np.ascontiguousarray(self.masks[:, word])
            both = column[a] & column[b]
            first = word * _LANGUAGES_PER_WORD
            for bit in range(min(_LANGUAGES_PER_WORD, len(self.languages) - first)):
                passed = np.concatenate([[0], ((both >> bit) & 1).cumsum(dtype=np.int64)])
                out[:, first + bit] = (passed[bounds[1:]] - passed[bounds[:-1]]) / size
        return np.maximum(0, (out - rates) / np.maximum(1 - rates, 1e-9))


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", slots: int = SLOTS, share: float = SHARE) -> LanguageFilter:
    """Learn the filter from all rows with a language."""
    counts = slot_counts(rows.filter(F.col(lang_col).isNotNull()), lang_col, text_col, slots)
    counts = stored(counts, "language-slots")
    totals = {r["lang"]: r["n"] for r in counts.filter("slot = -1").collect()}  # one row per language
    languages = sorted(totals)
    words = max(1, -(-len(languages) // _LANGUAGES_PER_WORD))
    masks = np.zeros((slots, words), np.int64)
    if languages:
        spark = counts.sparkSession
        known = spark.createDataFrame(
            [(x, i, float(max(1, totals[x]))) for i, x in enumerate(languages)], "lang string, number int, total double"
        )
        rated = counts.filter((F.col("slot") >= 0) & (F.col("n") >= MIN_COUNT)).join(F.broadcast(known), "lang")
        rated = rated.groupBy("slot").agg(
            F.collect_list(F.struct("number", (F.col("n") / F.col("total")).alias("rate"))).alias("rates")
        )
        top = F.array_max(F.transform("rates", lambda x: x.rate))
        ins = F.filter("rates", lambda x: x.rate >= share * F.col("top"))

        def mask(word: int):
            own = F.filter("ins", lambda x: F.floor(x.number / _LANGUAGES_PER_WORD) == word)
            return F.aggregate(
                own,
                F.lit(0).cast("bigint"),
                lambda m, x: m.bitwiseOR(F.pow(F.lit(2.0), x.number % _LANGUAGES_PER_WORD).cast("bigint")),
            )

        sets = rated.withColumn("top", top).withColumn("ins", ins)
        # At most one row per slot, whatever the data.
        got = sets.select("slot", *[mask(w).alias(f"m{w}") for w in range(words)]).toArrow()
        at = got.column(0).to_numpy()
        for word in range(words):
            masks[at, word] = got.column(1 + word).to_numpy()
    if len(languages) <= 8:
        masks = masks.astype(np.uint8)
    return LanguageFilter(languages, masks, slots)


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with the predicted language and its share among all languages' counts."""
    # Broadcasts hold plain values, as they are read where the package need not be installed.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.slots))

    def make():
        held = LanguageFilter(*shared.value)

        def compute(texts: pa.Array) -> list:
            langs, scores = [], []
            for first, data, offsets in slices(texts):
                letters = np.concatenate([[0], _ASCII_LETTER[data].cumsum()])
                lettered = (letters[offsets[1:]] - letters[offsets[:-1]]) > 0
                for i in np.flatnonzero(~lettered):
                    lettered[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                if not held.languages:
                    langs += [UNKNOWN] * len(lettered)
                    scores += [0.0] * len(lettered)
                    continue
                shares = held.shares(data, offsets)
                best, total = shares.argmax(1), shares.sum(1)
                top = shares[np.arange(len(best)), best]
                score = np.where(total > 0, top / np.maximum(total, 1e-300), 1 / len(held.languages))
                langs += [held.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores += np.where(lettered, score, 0.0).tolist()
            return [langs, scores]

        return compute

    return add_columns(docs, text_col, f"`{names[0]}` string, `{names[1]}` double", make)


def held_out(id_col: str):
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """One row per document: held out or not, predicted language, score."""
    rows = docs.select(id_col, lang_col, "text")
    model = fit(rows.filter(~held_out(id_col) & F.col(id_col).isNotNull()), lang_col)
    return predict(rows.select(id_col, held_out(id_col).alias("held_out"), "text"), model).drop("text")


def keep_known(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents to which a learned language could be given."""
    model = fit(docs.filter(~held_out(id_col)), lang_col, text_col)
    names = (fresh_name("lang_pred", docs.columns), fresh_name("lang_score", docs.columns))
    return predict(docs, model, text_col, names).filter(F.col(names[0]) != UNKNOWN).select(docs.columns)

"""Quality scores: random-indexing word vectors pooled per document, and a small calibrated network.

Every word gives two tokens: its letters and digits in lower case, and its shape (capitals, digits,
punctuation, length, whether it repeats one of the last four words). A token's index vector is random, sparse and fixed; its context vector is the
sum of the index vectors of its neighbours over the whole corpus. A document is the weighted mean
of its tokens' vectors, words and shapes apart. A network of two layers learns the label from the
pooled vectors of a bounded sample of labelled rows; a temperature, fitted on rows it did not
train on, calibrates its probabilities.

Context vectors cover all documents; they are summed per task in tables of fixed size. At most about
``sample`` labelled rows, chosen by hash, are pooled and sent to the driver.

Defined cases: null and empty texts have zero vectors and get the score of these; rows without a
label, and labels without a document, teach nothing; with labels of one class or none the score is
the smoothed share of label 1; repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, NOT_SPACE, PLAIN_WORD, Sums, Words, add_columns, byte_class, byte_values, fresh_name, mixed, slices

from .tables import summed

TOKENS = 4096  # of each kind
WIDTH = 32
NONZERO = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
LEAST_STEPS = 2000
THRESHOLD = 0.3
NEAR = 4
_UPPER = byte_class((0x41, 0x5A))
_DIGIT = byte_class((0x30, 0x39))
_PUNCTUATION = ~(PLAIN_WORD | _UPPER)


def _tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word tokens and shape tokens (numbered after the words) of rows, and where rows begin."""
    for _, data, offsets in slices(texts):
        words = Words(data, offsets, NOT_SPACE)
        start, end = words.start, words.end
        low = LOWER[data]
        core = Sums(byte_values(0)[low] * PLAIN_WORD[low]).spans(start, end)

        def count(flags: np.ndarray) -> np.ndarray:
            before = np.concatenate([[0], flags.cumsum()])
            return before[end] - before[start]

        mark = _PUNCTUATION[data]
        first = np.where(mark[start], data[start], 0) if len(start) else np.zeros(0, np.int64)
        last = np.where(mark[end - 1], data[end - 1], 0) if len(start) else np.zeros(0, np.int64)
        again = np.zeros(len(start), np.int64)
        row = words.row_of()
        for back in range(1, NEAR + 1):
            again[back:] += (core[back:] == core[:-back]) & (row[back:] == row[:-back])
        shape = np.zeros(len(start), np.uint64)
        for part, most in (
            (count(_UPPER[data]), 3),
            (count(_DIGIT[data]), 2),
            (count(mark), 4),
            ((end - start) // 4, 6),
            (first, 255),
            (last, 255),
            (again, 2),
        ):
            shape = shape * np.uint64(257) + np.minimum(part, most).astype(np.uint64)
        yield (
            (core % np.uint64(TOKENS)).astype(np.int64),
            (mixed(shape + np.uint64(1)) % np.uint64(TOKENS)).astype(np.int64) + TOKENS,
            words.rows,
        )


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each token's index vector."""
    rng = np.random.default_rng(3)
    return rng.integers(0, WIDTH, (2 * TOKENS, NONZERO)), rng.choice([-1.0, 1.0], (2 * TOKENS, NONZERO))


def context_table(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors of all tokens, and how often each occurs, over all rows."""
    length = 2 * TOKENS * WIDTH

    def table(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        places, signs = index_vectors()
        out, seen = np.zeros(length), np.zeros(2 * TOKENS)
        for batch in batches:
            for words, shapes, rows in _tokens(batch.column(0)):
                begins = np.zeros(len(words) + 1, bool)
                begins[rows] = True
                near = ~begins[1 : len(words)]  # a token and the next one are of one row
                for tokens in (words, shapes):
                    seen += np.bincount(tokens, minlength=2 * TOKENS)
                    a, b = tokens[:-1][near], tokens[1:][near]
                    for own, other in ((a, b), (b, a)):
                        for i in range(NONZERO):
                            out += np.bincount(own * WIDTH + places[other, i], signs[other, i], length)
        return np.concatenate([out, seen])

    total = summed(docs.select(text_col), length + 2 * TOKENS, table)
    return total[:length].reshape(2 * TOKENS, WIDTH), total[length:]


@dataclass
class Vectors:
    """Token vectors with their weights; ``pooled`` gives one row per text."""

    table: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, seen: np.ndarray) -> Vectors:
        size = np.linalg.norm(context, axis=1, keepdims=True)
        places, signs = index_vectors()
        index = np.zeros((len(seen), WIDTH))
        np.add.at(index, (np.arange(len(seen))[:, None], places), signs)
        table = np.hstack([context / np.maximum(size, 1e-9), index / np.sqrt(NONZERO)])
        share = (seen + 1) / (seen.sum() / 2 + TOKENS)
        return cls(table.astype(np.float32), (1e-2 / (1e-2 + share)).astype(np.float32))

    def pooled(self, texts: pa.Array) -> np.ndarray:
        out = []
        for words, shapes, rows in _tokens(texts):
            full = np.flatnonzero(np.diff(rows))
            parts = []
            for tokens in (words, shapes):
                pool = np.zeros((len(rows) - 1, self.table.shape[1]), np.float32)
                if len(full):
                    weight = self.weight[tokens]
                    sums = np.add.reduceat(self.table[tokens] * weight[:, None], rows[:-1][full])
                    pool[full] = sums / np.add.reduceat(weight, rows[:-1][full])[:, None]
                parts.append(pool)
            out.append(np.hstack(parts))
        return np.concatenate(out) if out else np.zeros((0, 2 * self.table.shape[1]), np.float32)


class Classifier:
    """Two layers on standardised inputs, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.share = (y.sum() + 1) / (len(y) + 2)
        self.plain = len(y) < 10 or y.min() == y.max()
        if self.plain:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        rng = np.random.default_rng(17)
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        check, train = order[:cut], order[cut:]
        x = (x - self.mean) / self.scale
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step = 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(train) // 256)))):
            turn = rng.permutation(train)
            for at in range(0, len(turn), 256):
                own = turn[at : at + 256]
                step += 1
                hidden = np.maximum(x[own] @ w[0] + w[1], 0)
                delta = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - y[own]) / len(own)
                back = np.outer(delta, w[2]) * (hidden > 0)
                grads = [x[own].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ delta, delta.sum(keepdims=True)]
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - 2e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        self.temperature = 1.0
        logits, truth = self.logits(x[check]), y[check]
        loss = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in np.geomspace(0.25, 8, 61)]
        self.temperature = float(np.geomspace(0.25, 8, 61)[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.full(len(pooled), self.share)
        logits = self.logits((pooled - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def held_out(id_col: str):
    """Rows that never teach: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> tuple[Vectors, Classifier]:
    """Vectors from all documents; the classifier from a hash sample of about ``sample`` labels."""
    vectors = Vectors.of(*context_table(docs, text_col))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label"))
    known = known.filter(F.col("__label").isin(0.0, 1.0) & F.col("__id").isNotNull())
    count = known.count()
    share = min(1.0, sample / max(count, 1))
    order = F.pmod(F.xxhash64(F.col("__id"), F.lit(29)), F.lit(1 << 30))
    chosen = known.filter(order < int(share * (1 << 30)) + 1)
    # About ``sample`` rows, whatever the number of labels.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    # Broadcasts hold plain values, as they are read where the package need not be installed.
    shared = docs.sparkSession.sparkContext.broadcast((vectors.table, vectors.weight))

    def make():
        held = Vectors(*shared.value)

        def compute(texts: pa.Array) -> list:
            pooled = held.pooled(texts)
            places = pa.array(np.arange(len(pooled) + 1) * pooled.shape[1], pa.int32())
            return [pa.ListArray.from_arrays(places, pa.array(pooled.ravel().astype(np.float32)))]

        return compute

    got = add_columns(rows, "__text", "pooled array<float>", make).select("__id", "__label", "pooled").toArrow()
    order = np.lexsort((got.column(1).to_numpy(), got.column(0).to_numpy()))  # whatever order rows arrive in
    x = np.array(got.column(2).to_pylist(), np.float64).reshape(-1, 4 * WIDTH)[order]
    return vectors, Classifier(x, got.column(1).to_numpy()[order])


def score(docs: DataFrame, model: tuple[Vectors, Classifier], text_col: str = "text") -> DataFrame:
    """The documents with ``score``, the probability of label 1, as the last column.

    The name gets underscores in front if the documents have a column of that name.
    """
    vectors, classifier = model
    shared = docs.sparkSession.sparkContext.broadcast((vectors.table, vectors.weight, vars(classifier)))

    def make():
        table, weight, state = shared.value
        vectors, classifier = Vectors(table, weight), Classifier.__new__(Classifier)
        vars(classifier).update(state)
        return lambda texts: [classifier.probability(vectors.pooled(texts))]

    return add_columns(docs, text_col, f"`{fresh_name('score', docs.columns)}` double", make)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: held out or not, score, prediction."""
    rows = docs.select(id_col, "text")
    model = fit(rows, labels.filter(~held_out(id_col)), id_col)
    scored = score(rows.withColumn("held_out", held_out(id_col)), model)
    return scored.select(id_col, "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Features: term counts, vocabulary, TF-IDF in long and vector form, text encoders."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from .bounded import fits_in_memory, lookup_join

# A vector model is sent to every task, so its vocabulary is measured first.
MAX_VOCABULARY_BYTES = 64 * 1024 * 1024
FEW_FEATURES = 100_000


def term_counts(df: DataFrame, key: str, text: str = "clean_text") -> DataFrame:
    """Rows ``(key, term, tf)`` of each document, counted inside its row.

    The sorted terms are cut where they change, so nothing is shuffled, and documents that share a
    key are never merged. Texts without terms give no array: a filter would be pushed below the steps
    that make the text and repeat all of them.
    """
    ordered = df.select(key, F.array_sort(X.terms(F.col(text))).alias("__w"))
    words, size = F.col("__w"), F.size("__w")
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
    )
    marked = ordered.withColumn("__at", F.when(size > 0, starts))
    runs = F.transform(
        "__at",
        lambda at, i: F.struct(
            F.get(words, at).alias("term"),
            (F.coalesce(F.get("__at", i + 1), size) - at).cast("bigint").alias("tf"),
        ),
    )
    return marked.select(key, F.inline(runs))


def term_totals(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """Rows ``(term, total, df)``: occurrences, and documents with the term.

    Each document gives its terms once more without repeats, so both sums come from one pass and
    combine per term before the shuffle; no (document, term) pair is ever shuffled.
    """
    words = F.col("__terms")

    def counted(array: Column, tf: int, df: int) -> Column:
        marks = F.lit(tf).alias("tf"), F.lit(df).alias("df")
        return F.transform(array, lambda w: F.struct(w.alias("term"), *marks))

    all_words = counted(words, 1, 0)
    once = counted(F.array_distinct(words), 0, 1)
    listed = df.select(X.terms(F.col(text)).alias("__terms")).select(
        F.inline(F.concat(all_words, once))
    )
    return listed.groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))


def vocabulary(totals: DataFrame, max_features: int = 5000) -> DataFrame:
    """The most frequent terms of a ``term_totals`` table, ties by term."""
    return totals.orderBy(F.desc("total"), "term").limit(max_features)


def tfidf(
    df: DataFrame,
    key: str,
    text: str = "clean_text",
    max_features: int = 5000,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Rows ``(key, term, weight)``: smooth idf ``ln((1+n)/(1+df))+1``, each document scaled to
    length one. ``fit_on`` gives other documents to learn the vocabulary from, such as the train
    part; by default all rows are used. Weights are made inside the row; no document is shuffled."""
    model = fit_tfidf(df if fit_on is None else fit_on, text, max_features)
    vectors = with_tfidf(df.select(key, text), model, text).select(
        key, F.unwrap_udt("features").alias("__v")
    )
    long = vectors.select(
        key, F.inline(F.arrays_zip("__v.indices", "__v.values")).alias("index", "weight")
    )
    terms = list(enumerate(model.stages[0].vocabulary))
    names = df.sparkSession.createDataFrame(terms, "index int, term string")
    return lookup_join(long, names, "index").select(key, "term", "weight")


def fit_tfidf(
    df: DataFrame,
    text: str = "clean_text",
    max_features: int = 5000,
    tokens: str = "terms",
    out: str = "features",
) -> PipelineModel:
    """The same weights as ``tfidf`` as a model that works inside each row, without a shuffle.

    Only the vocabulary, at most ``max_features`` rows, comes to the driver. The input of
    ``transform`` needs the array column made by ``with_terms``.
    """
    n_docs = df.count()
    chosen = vocabulary(term_totals(df, text), max_features)
    if max_features > FEW_FEATURES:
        chosen = chosen.persist()
        if not fits_in_memory(chosen, MAX_VOCABULARY_BYTES):
            raise ValueError("the vocabulary is too large for a vector model; lower max_features")
    words = chosen.collect()
    if max_features > FEW_FEATURES:
        chosen.unpersist()
    if not words:
        raise ValueError("no term of two or more letters in the corpus")
    idf = [math.log((1 + n_docs) / (1 + row["df"])) + 1 for row in words]
    count = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in words], inputCol=tokens, outputCol="__tf"
    )
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf"
    )
    return PipelineModel([count, scale, Normalizer(p=2.0, inputCol="__tfidf", outputCol=out)])


def with_terms(df: DataFrame, text: str = "clean_text", out: str = "terms") -> DataFrame:
    return df.withColumn(out, X.terms(F.col(text)))


def with_tfidf(df: DataFrame, model: PipelineModel, text: str = "clean_text") -> DataFrame:
    """Add the vector column of a ``fit_tfidf`` model."""
    return model.transform(with_terms(df, text)).drop("terms", "__tf", "__tfidf")


def tfidf_stages(model: PipelineModel, text: str = "clean_text") -> list:
    """The whole way from texts to ``features`` as savable stages: terms, then the fitted model."""
    pattern = P.TERM.replace("\\", "\\\\")
    terms = f"regexp_extract_all(lower(`{text}`), '{pattern}', 0) AS terms"
    return [SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__"), *model.stages]


Encoder = Callable[[DataFrame, str, str], DataFrame]


def hash_slot(text: bytes, size: int) -> tuple[int, float]:
    """The entry of a hashed feature and its sign, from the first and the ninth digit on of its MD5."""
    digest = hashlib.md5(text).hexdigest()
    return int(digest[:8], 16) % size, 1.0 if int(digest[8], 16) < 8 else -1.0


def hashed_rows(lists: list[list[bytes]], size: int) -> np.ndarray:
    """Signed counts of hashed features, one row per list, scaled to length one.

    Each distinct feature of the batch is hashed once.
    """
    flat = [x for features in lists for x in features]
    distinct = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    which = np.fromiter((distinct[x] for x in flat), np.int64, len(flat))
    return signed_rows(list(distinct), which, [len(x) for x in lists], size)


def signed_rows(distinct: list[bytes], which: np.ndarray, lengths: list[int], size: int) -> np.ndarray:
    """As ``hashed_rows``, of features given by their number in ``distinct``, row after row."""
    if not len(which):
        return np.zeros((len(lengths), size), np.float32)
    slots = [hash_slot(x, size) for x in distinct]
    at = np.array([s for s, _ in slots], np.int64)
    sign = np.array([s for _, s in slots])
    row = np.repeat(np.arange(len(lengths)), lengths)
    sums = np.bincount(row * size + at[which], sign[which], len(lengths) * size).reshape(-1, size)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.where(norms == 0, 1, norms)).astype(np.float32)


def hashing_encoder(size: int = 256) -> Encoder:
    """Built-in encoder: signed hashes of the words of the whole text, scaled to length one."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode_words(lists: pa.Array) -> pa.Array:
        words = [[w.encode() for w in words or ()] for words in lists.to_pylist()]
        values = hashed_rows(words, size)
        offsets = pa.array(np.arange(len(values) + 1) * size, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))

    def encode_with(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, encode_words(X.tokens(F.coalesce(F.col(text), F.lit("")))))

    return encode_with


def model_encoder(load: Callable[[], Callable], batch_size: int = 256) -> Encoder:
    """Encoder from a user's model: ``load()`` runs once per Python worker and returns a function
    from an array of texts to an array of shape (texts, size)."""
    predict = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)

    def encode_with(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, predict(F.coalesce(F.col(text), F.lit("None"))))

    return encode_with


def trigram_model(size: int = 128) -> Callable[[], Callable]:
    """A small model for ``model_encoder``: signed hashes of letter trigrams, length one."""

    def load() -> Callable:
        def encode_batch(texts: np.ndarray) -> np.ndarray:
            padded = [np.frombuffer(f"  {text} ".encode("utf-32-le"), np.uint32) for text in texts]
            # A trigram is one number, 21 bits for each letter.
            keys = [(p := x.astype(np.int64))[:-2] << 42 | p[1:-1] << 21 | p[2:] for x in padded]
            coded = pa.array(np.concatenate([np.empty(0, np.int64), *keys])).dictionary_encode()
            letters = [(k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) for k in coded.dictionary.to_pylist()]
            distinct = ["".join(map(chr, three)).encode() for three in letters]
            return signed_rows(distinct, coded.indices.to_numpy(), [len(k) for k in keys], size)

        return encode_batch

    return load


def encode(
    df: DataFrame, encoder: Encoder, text: str = "clean_text", out: str = "embedding"
) -> DataFrame:
    """Add an ``array<float>`` column with the vector of each text."""
    return encoder(df, text, out)


def with_vector(df: DataFrame, array: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array)))

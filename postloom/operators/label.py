"""Sentiment labels: scorers, label maps, annotation strategies, validation sheet."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CLASSES, STRATEGIES
from ..functions import patterns as P
from ..functions import text as X
from .bounded import lookup_dict, lookup_join, row_digest, settled, stored_once
from .curate import select_existing
from .sample import stratified_sample
from .text import ROW_LOOKUP_BYTES

DEFAULT_LABEL = "neutro"
ROW_KEYS = ["__row_a", "__row_b"]
# Class names of the two annotators and the corpus labels they stand for.
SHORT_NAMES = {"POS": "positivo", "NEG": "negativo", "NEU": "neutro"}
LONG_NAMES = {"positive": "positivo", "negative": "negativo", "neutral": "neutro"}

# Word weights of the two built-in annotators. The second one reads only plain opinion words.
OPINION_WORDS = {
    "bueno": 1, "buena": 1, "bien": 1, "mejor": 1, "gracias": 1, "vamos": 1, "gana": 1,
    "ganar": 1, "victoria": 2, "excelente": 2, "increíble": 2, "genial": 2, "orgullo": 2,
    "malo": -1, "mala": -1, "mal": -1, "peor": -1, "pierde": -1, "perder": -1, "fracaso": -2,
    "vergüenza": -2, "horrible": -2, "robo": -2, "asco": -2,
}
MOOD_WORDS = {
    "feliz": 1, "amor": 2, "celebracion": 2, "popular": 1, "sobresaliente": 1, "motivado": 1,
    "reconocimiento": 1, "triste": -1, "enojado": -2, "apesta": -2, "ridiculo": -1,
    "verguenza": -1,
}

Lexicon = Mapping[str, int]
Scorer = Callable[[Column], Column]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lexicon_hits(words: Column, lexicon: Lexicon) -> Column:
    """Struct ``(pos, neg)``: sums of the positive and the negative weights in an array of words.

    A fixed word list is compared inside the row, so nothing is shuffled or joined.
    """
    by_weight: dict[int, list[str]] = {}
    for word, weight in lexicon.items():
        by_weight.setdefault(weight, []).append(word)

    def total(found: Column, sign: int) -> Column:
        sums = [
            F.size(F.filter(found, lambda w: w.isin(*listed))) * abs(weight)
            for weight, listed in sorted(by_weight.items())
            if weight * sign > 0
        ]
        return sum(sums, F.lit(0))

    # One pass keeps the listed words; the sums then run over those few.
    listed_words = F.filter(words, lambda w: w.isin(*lexicon))
    return bind(
        listed_words,
        lambda found: F.struct(total(found, 1).alias("pos"), total(found, -1).alias("neg")),
    )


def _is_token(word: str) -> bool:
    inside = [c == "_" or unicodedata.category(c)[0] in "LN" for c in word.replace("'", "")]
    return all(inside) and all(word.split("'"))


def listed_tokens(text: Column, listed: Iterable[str]) -> Column:
    """Those of ``tokens(text)`` that are listed, in order, without listing the others."""
    words = sorted(filter(_is_token, listed))
    if not words:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    starts = "".join(sorted({re.escape(w[0]) for w in words}))
    whole = "|".join(map(re.escape, words))
    pattern = f"(?=[{starts}])(?<!{P.WORD})(?<!{P.WORD}')(?:{whole})(?!'?{P.WORD})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hit_probabilities(hits: Column, names: Sequence[str]) -> Column:
    """Map of class name to probability from whole positive and negative hits.

    Neutral gains when both signs occur; with whole numbers no two classes can tie for the top.
    """

    def shares(hit: Column) -> Column:
        pos, neg = hit["pos"], hit["neg"]
        neutral = 1.0 + 2.0 * F.least(pos, neg)
        mass = pos + neg + 1.0 + neutral
        parts = ((pos + 0.5) / mass, (neg + 0.5) / mass, neutral / mass)
        return F.create_map(*[x for n, s in zip(names, parts) for x in (F.lit(n), s)])

    return bind(hits, shares)


def lexicon_scorer(lexicon: Lexicon, names: Sequence[str] = tuple(SHORT_NAMES)) -> Scorer:
    """Text column to a map of class probabilities, by counting listed words."""

    def score(text: Column) -> Column:
        words = listed_tokens(F.coalesce(text, F.lit("")), lexicon)
        return hit_probabilities(lexicon_hits(words, lexicon), names)

    return score


def model_scorer(
    load: Callable[[], Callable],
    names: Sequence[str] = tuple(SHORT_NAMES),
    batch_size: int = 256,
    max_chars: int | None = None,
) -> Scorer:
    """Text column to class probabilities by a user's model.

    ``load()`` runs once per Python worker and returns a function from an array of texts to an
    array of shape (texts, classes). ``max_chars`` is for models that refuse longer inputs.
    """
    predict = predict_batch_udf(
        load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )

    def score(text: Column) -> Column:
        whole = F.coalesce(X.cap_text(text, max_chars), F.lit("None"))
        keys = F.array(*[F.lit(n) for n in names])
        return F.map_from_arrays(keys, predict(whole))

    return score


def with_table_hits(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "clean_text",
    row_bytes: int = ROW_LOOKUP_BYTES,
    **join_options: int,
) -> DataFrame:
    """As ``lexicon_hits`` for a ``(word, weight)`` table: adds ``pos`` and ``neg``.

    Of several weights of a word the smallest counts. Words that occur are looked up inside each row
    while they are measured below ``row_bytes``; beyond, sums per row are shuffled by its hash.
    """
    table = settled(lexicon.select("word", F.col("weight").cast("bigint").alias("weight")), "word", "weight")
    table = stored_once(table, "settled")
    tokens = X.tokens(F.coalesce(F.col(text), F.lit("")))
    weights = lookup_dict(df.select(F.explode(tokens).alias("word")), table, "word", "weight", row_bytes)
    if weights is not None:
        sums = _weight_function(df.sparkSession.sparkContext.broadcast(weights))
        summed = df.withColumn("__sums", sums(tokens))
        return summed.withColumns({"pos": F.col("__sums.pos"), "neg": F.col("__sums.neg")}).drop("__sums")
    marked = df.withColumns(dict(zip(ROW_KEYS, row_digest(df), strict=True)))
    once = marked.select(*ROW_KEYS, tokens.alias("__tokens")).dropDuplicates(ROW_KEYS)
    scored = lookup_join(once.select(*ROW_KEYS, F.explode("__tokens").alias("word")), table, "word", **join_options)
    weight = F.coalesce("weight", F.lit(0))
    sums = scored.groupBy(*ROW_KEYS).agg(
        F.sum(F.greatest(weight, F.lit(0))).alias("__pos"),
        F.sum(F.greatest(-weight, F.lit(0))).alias("__neg"),
    )
    found = {"pos": F.coalesce("__pos", F.lit(0)), "neg": F.coalesce("__neg", F.lit(0))}
    return marked.join(sums, ROW_KEYS, "left").withColumns(found).drop("__pos", "__neg", *ROW_KEYS)


def _weight_function(weights: Broadcast):
    @F.arrow_udf(T.StructType.fromDDL("pos bigint, neg bigint"))
    def sums(lists: pa.Array) -> pa.Array:
        # Each distinct word of the batch is looked up once.
        coded = lists.flatten().dictionary_encode()
        found = np.array([weights.value.get(w) or 0 for w in coded.dictionary.to_pylist()] + [0])
        value = found[coded.indices.to_numpy()]
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        columns = []
        for part in (np.maximum(value, 0), np.maximum(-value, 0)):
            running = np.concatenate([[0], part.cumsum()])
            columns.append(pa.array(running[ends] - running[ends - sizes], pa.int64()))
        return pa.StructArray.from_arrays(columns, names=["pos", "neg"])

    return sums


def map_labels(label: Column, names: Mapping[str, str], default: str = DEFAULT_LABEL) -> Column:
    """The corpus label of a model's label; unknown and null give the default."""
    pairs = [F.lit(part) for pair in names.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(default))


def argmax_label(scores: Column) -> Column:
    """Struct ``(label, confidence)`` of a map of probabilities: the first of the largest,
    rounded to three digits."""
    top = F.array_max(F.map_values(scores))
    at = F.array_position(F.map_values(scores), top).cast("int")
    return F.struct(
        F.try_element_at(F.map_keys(scores), at).alias("label"),
        F.bround(top.cast("double"), 3).alias("confidence"),
    )


@dataclass(frozen=True)
class Annotator:
    """A scorer, the names of its classes, and the columns it fills."""

    scorer: Scorer
    names: Mapping[str, str] = field(default_factory=lambda: dict(SHORT_NAMES))
    lower: bool = False
    label: str = "label_sentiment"
    confidence: str = "label_confidence"


def default_annotators() -> dict[str, Annotator]:
    return {
        "primary": Annotator(lexicon_scorer({**OPINION_WORDS, **MOOD_WORDS})),
        "secondary": Annotator(
            lexicon_scorer(OPINION_WORDS, tuple(LONG_NAMES)),
            LONG_NAMES,
            lower=True,
            label="label_secondary",
            confidence="label_conf_secondary",
        ),
    }


def score_texts(
    df: DataFrame, scorer: Scorer, text: str = "clean_text", out: str = "scores"
) -> DataFrame:
    return df.withColumn(out, scorer(F.col(text)))


def annotate(
    df: DataFrame,
    annotator: Annotator,
    text: str = "clean_text",
    label: str | None = None,
    confidence: str | None = None,
) -> DataFrame:
    """Add the label and the confidence of one annotator."""
    best = "__best"
    scored = score_texts(df, annotator.scorer, text, "__scores").withColumn(
        best, argmax_label(F.col("__scores"))
    )
    raw = F.col(f"{best}.label")
    named = map_labels(F.lower(raw) if annotator.lower else raw, annotator.names)
    return scored.withColumns(
        {
            label or annotator.label: named,
            confidence or annotator.confidence: F.col(f"{best}.confidence"),
        }
    ).drop("__scores", best)


def label_posts(
    df: DataFrame,
    strategy: str,
    annotators: Mapping[str, Annotator] | None = None,
    text: str = "clean_text",
) -> DataFrame:
    """Label with the ``primary``, the ``secondary`` or ``both`` annotators, or with ``none``.

    A single annotator always fills the official columns; with ``both`` the primary one does and
    the secondary one fills its own.
    """
    strategy = strategy.lower()
    if strategy not in STRATEGIES:
        raise ValueError(f"label strategy {strategy!r}; expected one of {STRATEGIES}")
    if strategy == "none":
        return df
    annotators = annotators or default_annotators()
    first = annotators["secondary" if strategy == "secondary" else "primary"]
    official = annotators["primary"]
    out = annotate(df, first, text, official.label, official.confidence)
    return annotate(out, annotators["secondary"], text) if strategy == "both" else out


def label_distribution(df: DataFrame, label: str = "label_sentiment") -> DataFrame:
    """Count, percentage and a text bar per label, most frequent first."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # One row per label; a null label counts in the total only.
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return (
        counts.withColumn("pct", share)
        .filter(F.col(label).isNotNull())
        .withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col("pct") / 2).cast("int")))
        .orderBy(F.desc("n"), label)
    )


def validation_sample(
    df: DataFrame,
    n: int = 150,
    seed: int = 42,
    key: str = "tweet_id_hashed",
    label: str = "label_sentiment",
    classes: Sequence[str] = CLASSES,
    extra: Sequence[str] = ("label_secondary",),
) -> DataFrame:
    """Sheet for human labels: a stratified sample with an empty ``label_manual`` column."""
    wanted = ["full_text", "clean_text", label, "label_confidence", *extra]
    drawn = stratified_sample(
        select_existing(df, list(dict.fromkeys([key, *wanted]))), n, seed, key, label, classes
    )
    return select_existing(drawn, [key, *wanted]).withColumn("label_manual", F.lit(""))

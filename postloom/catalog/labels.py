"""Labelling and agreement queries."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import agreement as A
from ..operators import label as LB
from . import sqltext as S
from .registry import LABELLED, query, stored
from .texts import CLEAN, clean_documents

# Weights for words that do occur in the supplied texts.
FIRST = {"para": 2, "con": 1, "with": 1, "for": 2, "mit": 1, "avec": 1, "feliz": 1, "amor": 2,
         "no": -1, "not": -1, "but": -2, "pas": -2, "nicht": -2, "sin": -1, "was": -1}
SECOND = {"para": 1, "con": 1, "with": 1, "feliz": 2, "für": 1, "no": -2, "not": -1, "was": -1,
          "ist": -1, "est": -1}


def _hits_sql(lexicon, sign: int) -> str:
    parts = []
    for weight in sorted({abs(w) for w in lexicon.values() if w * sign > 0}):
        words = ", ".join(S.quote(k) for k, w in lexicon.items() if w == sign * weight)
        parts.append(f"len(list_filter(toks, lambda w: w IN ({words}))) * {weight}")
    return " + ".join(parts)


def _label_sql(lexicon, label: str, confidence: str) -> str:
    """Select list over ``toks``: with whole hits, no two classes tie for the top."""
    pos, neg = f"({_hits_sql(lexicon, 1)})", f"({_hits_sql(lexicon, -1)})"
    neutral = f"(1 + 2 * least({pos}, {neg}))"
    mass = f"({pos} + {neg} + 1.0::DOUBLE + {neutral})"
    top = f"greatest({pos} + 0.5::DOUBLE, {neg} + 0.5::DOUBLE, {neutral})"
    return f"""CASE WHEN {pos} + 0.5 > greatest({neg} + 0.5, {neutral}) THEN 'positivo'
  WHEN {neg} + 0.5 > greatest({pos} + 0.5, {neutral}) THEN 'negativo' ELSE 'neutro' END AS {label},
  round_even({top} / {mass}, 3) AS {confidence}"""


TOKENS = f"{CLEAN}, toks AS (SELECT doc_id, {S.tokens_sql('clean_text')} AS toks FROM cleaned)"
BOTH = f"""both_labels AS (SELECT doc_id,
  {_label_sql(FIRST, 'label_sentiment', 'label_confidence')},
  {_label_sql(SECOND, 'label_secondary', 'label_conf_secondary')} FROM toks)"""


def annotators():
    return {
        "primary": LB.Annotator(LB.lexicon_scorer(FIRST)),
        "secondary": LB.Annotator(
            LB.lexicon_scorer(SECOND, ("POSITIVE", "NEGATIVE", "NEUTRAL")),
            LB.LONG_NAMES,
            lower=True,
            label="label_secondary",
            confidence="label_conf_secondary",
        ),
    }


@query(
    "lb1_lexicon_hits",
    f"WITH {TOKENS} SELECT doc_id, ({_hits_sql(FIRST, 1)})::INT AS pos,"
    f" ({_hits_sql(FIRST, -1)})::INT AS neg FROM toks",
)
def lexicon_hits(t):
    words = X.tokens(F.col("clean_text"))
    hits = clean_documents(t).select("doc_id", LB.lexicon_hits(words, FIRST).alias("hits"))
    return hits.select("doc_id", "hits.pos", "hits.neg")


# A lexicon learnt from the labels: +1 for words in more good than bad documents, else -1.
LEARNT = f"""learnt AS (
  SELECT word, CASE WHEN 2 * sum(quality) > count(*) THEN 1 ELSE -1 END AS weight
  FROM (SELECT DISTINCT doc_id, unnest({S.tokens_sql('lower(text)')}) AS word FROM documents) w
  JOIN labels l ON l.doc_id = w.doc_id GROUP BY word)"""


def learnt_lexicon(t):
    """Documents are joined before their words are listed, so that words are shuffled as sums only."""
    words = F.array_distinct(X.tokens(F.lower("text")))
    seen = t.documents.join(t.labels, "doc_id").select("quality", F.explode(words).alias("word"))
    good = F.when(2 * F.sum("quality") > F.count("*"), 1).otherwise(-1)
    return seen.groupBy("word").agg(good.alias("weight"))


LEARNT_SQL = f"""WITH {TOKENS}, {LEARNT}
SELECT t.doc_id, coalesce(sum(greatest(weight, 0)), 0)::BIGINT AS pos,
  coalesce(sum(greatest(-weight, 0)), 0)::BIGINT AS neg
FROM toks t LEFT JOIN (SELECT doc_id, unnest(toks) AS word FROM toks) w ON w.doc_id = t.doc_id
LEFT JOIN learnt l ON l.word = w.word GROUP BY t.doc_id"""


@query("lb1_lexicon_table", LEARNT_SQL)
def lexicon_table(t):
    docs = stored(t, clean_documents(t), "clean")
    return LB.with_table_hits(docs, learnt_lexicon(t)).select("doc_id", "pos", "neg")


@query("lb1_lexicon_table_large", LEARNT_SQL)
def lexicon_table_large(t):
    docs = stored(t, clean_documents(t), "clean")
    lexicon = learnt_lexicon(t)
    return LB.with_table_hits(docs, lexicon, row_bytes=0, max_bytes=0).select("doc_id", "pos", "neg")


def load_word_model():
    """A stand-in for a user's model: class probabilities of a batch of texts."""
    pattern = re.compile(r"\w+(?:'\w+)*")

    def score(texts: np.ndarray) -> np.ndarray:
        out = np.empty((len(texts), 3))
        for row, text in enumerate(texts):
            weights = [FIRST.get(w, 0) for w in pattern.findall(text)]
            pos, neg = sum(w for w in weights if w > 0), -sum(w for w in weights if w < 0)
            mass = np.array([pos + 0.5, neg + 0.5, 1.0 + 2 * min(pos, neg)])
            out[row] = mass / mass.sum()
        return out

    return score


@query(
    "lb1_model_scorer",
    f"""WITH {TOKENS}, both_labels AS (SELECT doc_id,
  {_label_sql(FIRST, 'label_sentiment', 'label_confidence')} FROM toks) SELECT * FROM both_labels""",
)
def model_scorer(t):
    annotator = LB.Annotator(LB.model_scorer(load_word_model))
    rows = LB.annotate(clean_documents(t), annotator)
    return rows.drop("clean_text")


@query(
    "lb2_map_labels",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'neutro' WHEN 'error' THEN 'negativo'
  WHEN 'purchase' THEN 'positivo' ELSE 'neutro' END AS label FROM events""",
)
def map_labels(t):
    names = {"view": "neutro", "error": "negativo", "purchase": "positivo"}
    return t.events.select(
        "event_id", LB.map_labels(F.lower(F.upper("event_type")), names).alias("label")
    )


@query(
    "lb3_argmax_label",
    """WITH p AS (SELECT doc_id, (n_chars % 7) / 10.0::DOUBLE AS a, (n_chars % 11) / 12.0::DOUBLE AS b,
  (n_chars % 13) / 14.0::DOUBLE AS c FROM documents)
SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label,
  round_even(greatest(a, b, c), 3) AS confidence FROM p""",
)
def argmax_label(t):
    n = F.col("n_chars")
    scores = F.create_map(
        F.lit("a"), (n % 7) / 10.0, F.lit("b"), (n % 11) / 12.0, F.lit("c"), (n % 13) / 14.0
    )
    return t.documents.select("doc_id", LB.argmax_label(scores).alias("best")).select(
        "doc_id", "best.label", "best.confidence"
    )


@query("lb4_label_both", f"WITH {TOKENS}, {BOTH} SELECT * FROM both_labels")
def label_both(t):
    return LB.label_posts(clean_documents(t), "both", annotators()).drop("clean_text")


@query(
    "lb4_label_secondary",
    f"""WITH {TOKENS}, {BOTH} SELECT doc_id, label_secondary AS label_sentiment,
  label_conf_secondary AS label_confidence FROM both_labels""",
)
def label_secondary(t):
    return LB.label_posts(clean_documents(t), "Secondary", annotators()).drop("clean_text")


def _kappa_sql(source: str, a: str, b: str) -> str:
    return f"""pairs AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2),
sides AS (SELECT a AS k, n AS ra, 0 AS rb FROM pairs UNION ALL SELECT b, 0, n FROM pairs),
margins AS (SELECT k, sum(ra) AS ra, sum(rb) AS rb FROM sides GROUP BY k),
agree AS (SELECT sum(n) FILTER (a = b) / sum(n) AS po, sum(n) AS n FROM pairs),
kap AS (SELECT round_even((po - pe) / (1 - pe), 4) AS kappa, agree.n::BIGINT AS n FROM agree,
  (SELECT sum(ra * rb) / (sum(ra) * sum(ra)) AS pe FROM margins))"""


@query(
    "lb5_cohen_kappa",
    f"""WITH {LABELLED}, {_kappa_sql('labelled', 'label_sentiment', 'label_secondary')}
SELECT kappa, n FROM kap""",
)
def kappa(t):
    return A.cohen_kappa(t.labelled, "label_sentiment", "label_secondary")


@query(
    "lb5_kappa_of_annotators",
    f"""WITH {TOKENS}, {BOTH}, {_kappa_sql('both_labels', 'label_sentiment', 'label_secondary')}
SELECT kappa, n FROM kap""",
)
def annotator_kappa(t):
    rows = LB.label_posts(clean_documents(t), "both", annotators())
    return A.cohen_kappa(rows, "label_sentiment", "label_secondary")


@query(
    "lb6_interpret_kappa",
    """SELECT doc_id, CASE WHEN k >= 0.8 THEN 'casi perfecto' WHEN k >= 0.6 THEN 'sustancial'
  WHEN k >= 0.4 THEN 'moderado' ELSE 'pobre' END AS level
FROM (SELECT doc_id, (n_chars % 101) / 100.0::DOUBLE AS k FROM documents)""",
)
def interpret(t):
    return t.documents.select(
        "doc_id", A.interpret_kappa((F.col("n_chars") % 101) / 100.0).alias("level")
    )


@query(
    "lb7_label_distribution",
    f"""WITH {LABELLED}, c AS (SELECT label_sentiment, count(*) AS n FROM labelled GROUP BY 1)
SELECT label_sentiment, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct,
  repeat('█', floor(n * 100.0 / sum(n) OVER () / 2)::INT) AS bar FROM c""",
)
def distribution(t):
    return LB.label_distribution(t.labelled).withColumn("pct", F.round("pct", 6))


@query(
    "lb8_validation_sample",
    f"""WITH {LABELLED} SELECT id, full_text, label_sentiment, label_confidence, label_secondary,
  '' AS label_manual FROM labelled
QUALIFY row_number() OVER (PARTITION BY label_sentiment ORDER BY md5('42:' || id), id) <= 50""",
)
def validation(t):
    return LB.validation_sample(t.labelled, 150, 42, "id")


@query(
    "lb9_kappa_report",
    f"""WITH {LABELLED}, {_kappa_sql('labelled', 'label_sentiment', 'label_secondary')}
SELECT kappa, CASE WHEN kappa >= 0.8 THEN 'casi perfecto' WHEN kappa >= 0.6 THEN 'sustancial'
  WHEN kappa >= 0.4 THEN 'moderado' ELSE 'pobre' END AS interpretation, n, 42 AS seed FROM kap""",
)
def report(t):
    return A.kappa_report(t.labelled, "label_sentiment", "label_secondary")

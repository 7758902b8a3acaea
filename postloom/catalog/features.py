"""Feature and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import heavy as HH
from ..operators import models as ML
from ..operators import text as TX
from ..operators.once import once_per_text
from ..operators.sample import hash_split
from ..plans import train as TR
from ..session import shared_dir
from . import sqltext as S
from .registry import LABELLED, query, stored
from .texts import CLEAN, clean_documents

COUNTS = f"""{CLEAN}, counts AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({S.terms_sql('clean_text')}) AS term FROM cleaned) GROUP BY ALL)"""


def _vocabulary(k: int) -> str:
    return f"""vocab AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM counts
  GROUP BY term ORDER BY total DESC, term LIMIT {k})"""


@query("fe1_term_counts", f"WITH {COUNTS} SELECT * FROM counts")
def term_counts(t):
    return FE.term_counts(clean_documents(t), "doc_id")


@query("fe2_vocabulary", f"WITH {COUNTS}, {_vocabulary(5000)} SELECT * FROM vocab")
def vocabulary(t):
    return FE.vocabulary(FE.term_totals(clean_documents(t)))


@query(
    "fe2_top_terms_bounded",
    f"WITH {COUNTS} SELECT term, sum(tf)::BIGINT AS total FROM counts GROUP BY term ORDER BY total DESC, term LIMIT 500",
)
def top_terms_bounded(t):
    """Terms by summaries of bounded size; the clean texts are stored, as they are read twice."""
    clean = stored(t, clean_documents(t).select("clean_text"), "clean")
    return HH.top_terms(clean, 500)


TFIDF = f"""raw AS (
  SELECT c.doc_id, c.term, c.tf * (ln((1 + n) / (1.0::DOUBLE + v.df)) + 1) AS raw
  FROM counts c JOIN vocab v ON v.term = c.term, (SELECT count(*) AS n FROM documents)),
weights AS (SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6)
  AS weight FROM raw)"""


@query("fe3_tfidf", f"WITH {COUNTS}, {_vocabulary(5000)}, {TFIDF} SELECT * FROM weights")
def tfidf(t):
    """Clean texts are stored, as they are counted, learnt from and weighted."""
    rows = FE.tfidf(stored(t, clean_documents(t), "clean"), "doc_id")
    return rows.withColumn("weight", F.round("weight", 6))


@query(
    "fe3_tfidf_vectors",
    f"""WITH {COUNTS}, {_vocabulary(5000)}, {TFIDF} SELECT d.doc_id,
  coalesce(sum(CAST(weight AS DECIMAL(18, 6))), 0)::DOUBLE AS weight_sum, count(term) AS n_terms
FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def tfidf_vectors(t):
    docs = stored(t, clean_documents(t), "clean")
    rows = FE.with_tfidf(docs, FE.fit_tfidf(docs))
    weights = F.unwrap_udt("features")["values"]
    zero = F.lit(0).cast("decimal(28,6)")
    total = F.aggregate(
        weights, zero, lambda acc, w: (acc + F.round(w, 6).cast("decimal(18,6)")).cast("decimal(28,6)")
    )
    return rows.select(
        "doc_id",
        total.cast("double").alias("weight_sum"),
        F.size(weights).cast("bigint").alias("n_terms"),
    )


def _encoded_sql(features: str, size: int) -> str:
    """Long form of the hashing rule over ``(doc_id, w)`` rows: signed counts, length one."""
    return f"""feats AS ({features}),
slots AS (SELECT doc_id, ('0x' || left(md5(w), 8))::UBIGINT % {size} AS i,
  CASE WHEN ('0x' || md5(w)[9])::UBIGINT < 8 THEN 1 ELSE -1 END AS sign FROM feats),
sums AS (SELECT doc_id, i, sum(sign) AS s FROM slots GROUP BY ALL)
SELECT doc_id, CAST(i AS BIGINT) AS i,
  CAST(round(12 * s / min(abs(s)) OVER (PARTITION BY doc_id)) AS BIGINT) AS twelfths FROM sums WHERE s <> 0"""


def _long(rows):
    """Entries as twelfths of the document's smallest one: whole numbers, free of rounding."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    least = F.array_min(F.filter(F.transform(values, F.abs), lambda x: x > 0))
    listed = rows.select("doc_id", least.alias("least"), F.posexplode(values).alias("i", "value"))
    ratio = F.round(12 * F.col("value") / F.col("least")).cast("bigint")
    return listed.filter("value <> 0").select("doc_id", F.col("i").cast("bigint"), ratio.alias("twelfths"))


WORDS_SQL = f"WITH {CLEAN}, " + _encoded_sql(
    f"SELECT doc_id, unnest({S.tokens_sql('clean_text')}) AS w FROM cleaned", 256
)
TRIGRAMS_SQL = f"WITH {CLEAN}, padded AS (SELECT doc_id, '  ' || clean_text || ' ' AS p FROM cleaned), " + _encoded_sql(
    "SELECT doc_id, substr(p, i, 3) AS w FROM padded, unnest(range(1, length(p) - 1)) AS r(i)", 128
)


@query("fe4_encode_a", WORDS_SQL)
def encode_a(t):
    return _long(FE.encode(clean_documents(t), FE.hashing_encoder()))


@query("fe5_encode_b", TRIGRAMS_SQL)
def encode_b(t):
    return _long(FE.encode(clean_documents(t), FE.model_encoder(FE.trigram_model())))


def _encoded_once(t, encoder):
    """Clean texts are stored, as the distinct ones and the join back both read them."""
    clean = stored(t, clean_documents(t).select("doc_id", "clean_text"), "clean")
    return _long(once_per_text(clean, "clean_text", lambda rows: FE.encode(rows, encoder)))


@query("fe4_encode_a_once", WORDS_SQL)
def encode_a_once(t):
    return _encoded_once(t, FE.hashing_encoder())


@query("fe5_encode_b_once", TRIGRAMS_SQL)
def encode_b_once(t):
    return _encoded_once(t, FE.model_encoder(FE.trigram_model()))


VECTOR_CLASSES = tuple(f"c{i}" for i in range(10))


def labelled_vectors(t):
    """The supplied embeddings with their labels as text."""
    rows = FE.with_vector(t.embeddings)
    return rows.select("vec_id", F.concat(F.lit("c"), "label").alias("label"), "features")


def _fitted(t, kind: str):
    """A model of the vectors in the train part, and all vectors."""
    rows = stored(t, labelled_vectors(t), "vectors")
    fit_rows, _ = ML.in_fit_tasks(hash_split(rows, "vec_id")[0])
    return ML.train(fit_rows, kind, "label", classes=VECTOR_CLASSES, tol=1e-7 if kind == "lr" else 1e-4), rows


IN_TEST = "('0x' || left(md5('42:' || {key}), 8))::UBIGINT % 100 < 20"
LABELLED_CLEAN = f"""{LABELLED}, {S.cleaned_cte('labelled', 'full_text')},
docs AS (SELECT id AS doc_id, clean_text, label_sentiment AS label, {IN_TEST.format(key='id')} AS held
  FROM cleaned),
counts AS (SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({S.terms_sql('clean_text')}) AS term FROM docs) GROUP BY ALL)"""
# Multinomial naive Bayes with smoothing 1, learnt from the train part.
BAYES = f"""{_vocabulary(5000)},
raw AS (SELECT c.doc_id, c.term, c.tf * (ln((1 + n) / (1.0::DOUBLE + v.df)) + 1) AS raw
  FROM counts c JOIN vocab v ON v.term = c.term, (SELECT count(*) AS n FROM docs)),
weights AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM raw),
prior AS (SELECT label, ln(count(*) + 1) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS p
  FROM docs WHERE NOT held GROUP BY label),
mass AS (SELECT label, term, sum(w) AS s FROM weights JOIN docs USING (doc_id) WHERE NOT held GROUP BY ALL),
grid AS (SELECT label, term, coalesce(s, 0) + 1 AS s FROM (SELECT label, term FROM prior, vocab)
  LEFT JOIN mass USING (label, term)),
theta AS (SELECT label, term, ln(s) - ln(sum(s) OVER (PARTITION BY label)) AS t FROM grid),
scores AS (SELECT d.doc_id, p.label, any_value(p.p) + coalesce(sum(w * t), 0) AS score
  FROM docs d CROSS JOIN prior p LEFT JOIN weights w ON w.doc_id = d.doc_id
  LEFT JOIN theta h ON h.label = p.label AND h.term = w.term GROUP BY d.doc_id, p.label),
best AS (SELECT doc_id, arg_max(label, score) AS predicted FROM scores GROUP BY doc_id)
SELECT d.doc_id AS id, d.label AS label_sentiment, b.predicted FROM docs d JOIN best b USING (doc_id)"""


def labelled_texts(t):
    clean = TX.with_clean_text(t.labelled.select("id", "full_text", "label_sentiment"))
    return stored(t, clean.select("id", "clean_text", "label_sentiment"), "labelled")


def _bayes_on_texts(t):
    rows = labelled_texts(t)
    fit_rows, _ = hash_split(rows, "id")
    vectors = FE.fit_tfidf(rows)
    fit_rows = stored(t, FE.with_tfidf(fit_rows, vectors).select("label_sentiment", "features"), "features")
    return rows, vectors, ML.train(fit_rows, "nb")


@query("ml1_naive_bayes", f"WITH {LABELLED_CLEAN}, {BAYES}")
def naive_bayes(t):
    rows, vectors, model = _bayes_on_texts(t)
    found = ML.predict(model, FE.with_tfidf(rows, vectors))
    return found.select("id", "label_sentiment", "predicted")


@query("ml2_logistic_regression")
def logistic_regression(t):
    """Predictions of all vectors with the probability of the predicted class; learnt from the train part."""
    model, rows = _fitted(t, "lr")
    found = model.transform(rows)
    likely = F.array_max(FE.vector_to_array("probability"))
    return found.select("vec_id", "label", "predicted", F.round(likely, 4).alias("probability"))


@query("ml3_linear_svm")
def linear_svm(t):
    """Predictions of all vectors with the highest score; planes learnt from the train part."""
    model, rows = _fitted(t, "svm")
    found = model.transform(rows)
    return found.select("vec_id", "label", "predicted", F.round(F.array_max("rawPrediction"), 4).alias("score"))


@query("ml4_predict_tfidf", f"WITH {LABELLED_CLEAN}, {BAYES} WHERE d.held")
def predict_tfidf(t):
    rows, vectors, model = _bayes_on_texts(t)
    _, test_rows = hash_split(rows, "id")
    found = ML.predict(model, FE.with_tfidf(test_rows, vectors))
    return found.select("id", "label_sentiment", "predicted")


@query(
    "ml5_weighted_prf",
    f"""WITH {LABELLED}, pairs AS (
  SELECT label_sentiment AS y, label_secondary AS p, count(*) AS n FROM labelled GROUP BY ALL),
classes AS (SELECT y AS k FROM pairs UNION SELECT p FROM pairs),
scores AS (SELECT k, coalesce(sum(n) FILTER (y = k), 0) AS support,
  coalesce(sum(n) FILTER (p = k), 0) AS given, coalesce(sum(n) FILTER (y = k AND p = k), 0) AS hits
  FROM classes, pairs GROUP BY k)
SELECT round(sum(support * CASE WHEN given = 0 THEN 0 ELSE hits / given END) / sum(support), 6)
    AS precision,
  round(sum(support * CASE WHEN support = 0 THEN 0 ELSE hits / support END) / sum(support), 6)
    AS recall,
  round(sum(support * CASE WHEN given + support = 0 THEN 0 ELSE 2 * hits / (given + support) END)
    / sum(support), 6) AS f1 FROM scores""",
)
def weighted_prf(t):
    rows = ML.weighted_prf(t.labelled, "label_sentiment", "label_secondary")
    return rows.select([F.round(c, 6).alias(c) for c in rows.columns])


@query("ml6_compare_tfidf")
def compare_tfidf(t):
    return TR.compare_tfidf(labelled_texts(t), "id")


@query("ml6_compare_encoders")
def compare_encoders(t):
    return TR.compare_encoders(labelled_texts(t), key="id")


@query("io9_save_and_load_model")
def stored_model(t):
    """Predictions of models that were saved and loaded again."""
    out = None
    for kind in ("lr", "svm"):
        model, rows = _fitted(t, kind)
        path = shared_dir(t.spark, "model")
        ML.save_model(model, path)
        found = ML.predict(ML.load_model(path), rows).select("vec_id", F.lit(kind).alias("model"), "predicted")
        out = found if out is None else out.unionByName(found)
    return out

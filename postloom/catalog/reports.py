"""Report queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..config import CLASSES, REPORT_STOPWORDS
from ..functions import patterns as P
from ..operators import agreement as A
from ..operators import models as ML
from ..operators import report as RP
from ..operators import text as TX
from ..operators.curate import filter_posts
from ..plans.report import load_report_inputs, load_stored_inputs, store_report_inputs
from ..session import shared_dir
from ..sources.corpus import with_epoch_times, write_corpus
from ..sources.delimited import write_table_csv
from ..sources.post_store import read_posts, write_posts
from ..streaming.activity import read_activity, run_activity, stream_activity
from . import sqltext as S
from .registry import LABELLED, query


def _round(df, *cols: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "rp1_kpis",
    f"""WITH {LABELLED} SELECT count(*) AS total,
  {", ".join(f'''count(*) FILTER (label_sentiment = '{c}') AS {c},
  round(count(*) FILTER (label_sentiment = '{c}') * 100.0 / count(*), 6) AS {c}_pct''' for c in CLASSES)},
  round(count(*) FILTER (label_sentiment = label_secondary) * 100.0 / count(*), 6) AS agreement_pct,
  round(avg(label_confidence) * 100, 6) AS confidence_pct FROM labelled""",
)
def kpis(t):
    shares = [f"{c}_pct" for c in (*CLASSES, "agreement", "confidence")]
    return _round(RP.kpis(t.labelled), *shares)


@query(
    "rp2_activity",
    f"""WITH {LABELLED} SELECT strftime(time_bucket(INTERVAL 30 MINUTE, created_at),
  '%Y-%m-%d %H:%M:%S') AS created_at, label_sentiment, count(*) AS count FROM labelled GROUP BY ALL""",
)
def activity(t):
    return _spelled(RP.activity(t.labelled))


@query(
    "rp2_activity_events",
    """SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS ts, event_type,
  count(*) AS count FROM events GROUP BY ALL""",
)
def activity_events(t):
    return _spelled(RP.activity(t.events, "ts", "event_type"), "ts")


@query(
    "rp2_activity_stream",
    """SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS ts, event_type,
  count(*) AS count FROM events GROUP BY ALL""",
)
def activity_stream(t):
    """All events arrive in four portions in order of time; the stream is stopped and restarted between them."""
    folder = shared_dir(t.spark, "stream")
    low, high = t.events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * i / 4 for i in range(1, 4)] if low is not None else []
    place = sum([(F.col("ts") >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    for portion in range(4):
        arrived = t.events.filter(F.coalesce(place, F.lit(0)) == portion).select("ts", "event_type")
        arrived.write.mode("append").parquet(f"{folder}/in")
        if portion % 2:
            events = t.spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
            run_activity(stream_activity(events, "ts", "event_type"), f"{folder}/out", f"{folder}/state")
    return _spelled(read_activity(t.spark, f"{folder}/out", "ts", "event_type"), "ts")


def _spelled(df, ts: str = "created_at"):
    return df.withColumn(ts, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


@query(
    "rp3_class_shares",
    f"""WITH {LABELLED} SELECT k AS label_sentiment, count(l.id) AS n,
  round(count(l.id) * 100.0 / (SELECT count(*) FROM labelled), 6) AS pct
FROM (SELECT unnest({list(CLASSES)}) AS k) c LEFT JOIN labelled l ON l.label_sentiment = k
GROUP BY k""",
)
def class_shares(t):
    return _round(RP.class_shares(t.labelled), "pct")


@query(
    "rp4_agreement_matrix",
    f"""WITH {LABELLED}, classes AS (SELECT unnest({list(CLASSES)}) AS k),
dense AS (SELECT x.k AS a, y.k AS b, count(l.id) AS count FROM classes x CROSS JOIN classes y
  LEFT JOIN labelled l ON l.label_sentiment = x.k AND l.label_secondary = y.k GROUP BY 1, 2)
SELECT a, b, count, round_even(CASE WHEN sum(count) OVER (PARTITION BY a) > 0 THEN
  count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY a) END, 1) AS pct FROM dense""",
)
def agreement_matrix(t):
    return A.agreement_matrix(t.labelled, "label_sentiment", "label_secondary")


def _histogram_sql(step: float) -> str:
    return f"""WITH {LABELLED}, long AS (
  SELECT 'label_confidence' AS annotator, label_confidence AS x FROM labelled
  UNION ALL SELECT 'label_conf_secondary', label_conf_secondary FROM labelled)
SELECT annotator, round(floor(x / {step} + 1e-9) * {step}, 9) AS bin_start, count(*) AS n
FROM long WHERE x IS NOT NULL GROUP BY 1, 2"""


@query("rp5_confidence_histogram", _histogram_sql(0.05))
def confidence_histogram(t):
    return RP.confidence_histogram(t.labelled)


@query("rp5_confidence_histogram_step", _histogram_sql(0.2))
def confidence_histogram_step(t):
    return RP.confidence_histogram(t.labelled, step=0.2)


def _words_sql(word_class: str, fold: bool) -> str:
    stop = ", ".join(S.quote(w) for w in REPORT_STOPWORDS)
    folded = """SELECT CASE WHEN b.word IS NOT NULL THEN b.word ELSE c.word END AS word, c.n FROM c
  LEFT JOIN c b ON c.word LIKE '%s' AND c.word NOT LIKE '%ss'
    AND b.word = left(c.word, length(c.word) - 1)"""
    return f"""WITH {LABELLED}, {S.cleaned_cte('labelled', 'full_text')}, w AS (
  SELECT regexp_replace(unnest(regexp_extract_all(lower(clean_text), {S.quote(P.CLOUD_WORD)})),
    '''s$', '') AS word FROM cleaned WHERE label_sentiment = '{word_class}'),
c AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN ({stop})
  AND NOT regexp_matches(word, '^\\p{{Nd}}+$') GROUP BY word)
SELECT word, sum(n)::BIGINT AS n FROM ({folded if fold else 'SELECT * FROM c'}) GROUP BY word
ORDER BY n DESC, word LIMIT 80"""


@query("rp6_top_words", _words_sql("negativo", True))
def top_words(t):
    return RP.top_words(TX.with_clean_text(t.labelled), "negativo")


@query("rp6_top_words_unfolded", _words_sql("positivo", False))
def top_words_unfolded(t):
    return RP.top_words(TX.with_clean_text(t.labelled), "positivo", fold_plurals=False)


@query(
    "rp7_top_sources",
    f"""WITH {LABELLED} SELECT source, count(*) AS n FROM labelled
WHERE label_sentiment IN ('positivo', 'negativo') AND hour(created_at) BETWEEN 0 AND 12
GROUP BY source ORDER BY n DESC, source LIMIT 7""",
)
def top_sources(t):
    return RP.top_values(filter_posts(t.labelled, ["positivo", "negativo"], 0, 12))


@query(
    "rp8_top_posts",
    f"""WITH {LABELLED} SELECT id,
  CASE WHEN length(full_text) > 220 THEN left(full_text, 220) || '...' ELSE full_text END AS full_text,
  retweet_count, favorite_count, label_confidence,
  round_even(label_confidence * 100, 0)::INT || '%' AS confidence_pct
FROM labelled WHERE label_sentiment = 'negativo' ORDER BY retweet_count DESC, id LIMIT 5""",
)
def top_posts(t):
    return RP.top_posts(t.labelled, "negativo")


def post_store(t) -> str:
    """All labelled posts, stored by language and day."""
    path = shared_dir(t.spark, "posts")
    write_posts(t.labelled, path)
    return path


@query(
    "rp7_top_sources_stored",
    f"""WITH {LABELLED} SELECT source, count(*) AS n FROM labelled
WHERE label_sentiment IN ('positivo', 'negativo') AND hour(created_at) BETWEEN 0 AND 12
GROUP BY source ORDER BY n DESC, source LIMIT 7""",
)
def top_sources_stored(t):
    labels = ["positivo", "negativo"]
    rows = read_posts(t.spark, post_store(t), t.labelled.schema, labels=labels)
    return RP.top_values(filter_posts(rows, labels, 0, 12))


@query(
    "rp8_top_posts_stored",
    f"""WITH {LABELLED} SELECT id,
  CASE WHEN length(full_text) > 220 THEN left(full_text, 220) || '...' ELSE full_text END AS full_text,
  retweet_count, favorite_count, label_confidence,
  round_even(label_confidence * 100, 0)::INT || '%' AS confidence_pct
FROM labelled WHERE label_sentiment = 'negativo' ORDER BY retweet_count DESC, id LIMIT 5""",
)
def top_posts_stored(t):
    return RP.top_posts(read_posts(t.spark, post_store(t), t.labelled.schema, labels=["negativo"]), "negativo")


# Metrics of two predictions per language: either annotator judged by the other one.
METRICS = """pairs AS (SELECT lang, k, y, p, count(*) AS n FROM (
  SELECT lang, 'x' AS k, label_sentiment AS y, label_secondary AS p FROM labelled UNION ALL
  SELECT lang, 'y', label_secondary, label_sentiment FROM labelled) GROUP BY ALL),
kinds AS (SELECT lang, k, y AS c FROM pairs UNION SELECT lang, k, p FROM pairs),
scores AS (SELECT lang, k, c, coalesce(sum(n) FILTER (y = c), 0) AS support,
  coalesce(sum(n) FILTER (p = c), 0) AS given, coalesce(sum(n) FILTER (y = c AND p = c), 0) AS hits
  FROM kinds JOIN pairs USING (lang, k) GROUP BY ALL),
metrics AS (SELECT lang || '_' || k AS model, k,
  round(sum(CASE WHEN given = 0 THEN 0 ELSE support * hits / given END) / sum(support), 6) AS precision,
  round(sum(hits) / sum(support), 6) AS recall,
  round(sum(CASE WHEN given + support = 0 THEN 0 ELSE 2 * support * hits / (given + support) END)
    / sum(support), 6) AS f1 FROM scores GROUP BY lang, k)"""


def language_metrics(t, tag: str):
    y, p = ("label_sentiment", "label_secondary") if tag == "x" else ("label_secondary", "label_sentiment")
    scores = ML.weighted_prf_by(t.labelled.filter("lang IS NOT NULL"), y, p, "lang")
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return scores.select(F.concat("lang", F.lit(f"_{tag}")).alias("model"), *rounded)


@query(
    "rp9_compare_metrics",
    f"""WITH {LABELLED}, {METRICS} SELECT model, precision, recall, f1,
  CASE k WHEN 'x' THEN 'TF-IDF' ELSE 'Embeddings' END AS tipo FROM metrics""",
)
def compare_metrics(t):
    return RP.compare_metrics(language_metrics(t, "x"), language_metrics(t, "y"))


@query(
    "rp10_format_metrics",
    f"""WITH {LABELLED}, {METRICS} SELECT model, printf('%.3f', precision) AS precision,
  printf('%.3f', recall) AS recall, printf('%.3f', f1) AS f1 FROM metrics WHERE k = 'x'""",
)
def format_metrics(t):
    return RP.format_metrics(language_metrics(t, "x"))


@query(
    "rp11_explore",
    f"""WITH {LABELLED} SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, full_text,
  label_sentiment, label_confidence, label_secondary, label_conf_secondary, retweet_count,
  favorite_count, source
FROM labelled WHERE label_sentiment IN ('positivo', 'neutro') AND hour(created_at) BETWEEN 6 AND 18
ORDER BY labelled.created_at, id LIMIT 100""",
)
def explore(t):
    rows = filter_posts(t.labelled, ["positivo", "neutro"], 6, 18)
    return _spelled(RP.explore(rows, ["created_at", "id"]))


@query(
    "rp11_explore_stored",
    f"""WITH {LABELLED} SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, full_text,
  label_sentiment, label_confidence, label_secondary, label_conf_secondary, retweet_count,
  favorite_count, source
FROM labelled WHERE lang IN ('en', 'es') AND label_sentiment IN ('positivo', 'neutro')
  AND created_at::DATE BETWEEN '2024-01-01' AND '2024-01-02' AND hour(created_at) BETWEEN 6 AND 18
ORDER BY labelled.created_at, id""",
)
def explore_stored(t):
    """All posts of two languages, two labels, two days and some hours, as the explorer asks for them."""
    first, labels = datetime.date(2024, 1, 1), ["positivo", "neutro"]
    last = first + datetime.timedelta(days=1)
    rows = read_posts(t.spark, post_store(t), t.labelled.schema, ["en", "es"], first, last, labels)
    return _spelled(RP.explore(filter_posts(rows, labels, 6, 18), ["created_at", "id"], None))


@query(
    "rp12_load_report_inputs",
    f"""WITH {LABELLED}, {METRICS}, tables AS (
  SELECT 'x' AS k, count(*) AS n_models, max(f1) AS best FROM metrics WHERE k = 'x'
  UNION ALL SELECT 'y', count(*), max(f1) FROM metrics WHERE k = 'y')
SELECT label_sentiment, count(*) AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_post,
  min(x.n_models) AS base_models, round(min(y.best), 6) AS best_embedding
FROM labelled, (SELECT * FROM tables WHERE k = 'x') x, (SELECT * FROM tables WHERE k = 'y') y
GROUP BY label_sentiment""",
)
def report_inputs(t):
    folder = shared_dir(t.spark, "report")
    write_corpus(with_epoch_times(t.labelled), f"{folder}/corpus")
    write_table_csv(language_metrics(t, "x"), f"{folder}/base")
    write_table_csv(language_metrics(t, "y"), f"{folder}/embedded")
    schema = t.labelled.schema.simpleString()[7:-1].replace("timestamp_ntz", "string")
    inputs = load_report_inputs(
        t.spark,
        f"{folder}/corpus",
        f"{folder}/base",
        f"{folder}/embedded",
        schema.replace(":", " "),
    )
    first = F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss")
    return inputs.posts.groupBy("label_sentiment").agg(
        F.count("*").alias("n"),
        first.alias("first_post"),
        inputs.base_metrics.agg(F.count("*")).scalar().alias("base_models"),
        F.round(inputs.embedding_metrics.agg(F.max("f1")).scalar(), 6).alias("best_embedding"),
    )


@query(
    "rp12_stored_report_inputs",
    f"""WITH {LABELLED}, {METRICS} SELECT label_sentiment, label_secondary, lang, count(*) AS n,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_post,
  (SELECT count(*) FROM metrics WHERE k = 'x') AS base_models,
  (SELECT count(*) FROM metrics WHERE k = 'y') AS embedding_models
FROM labelled WHERE full_text IS NOT NULL GROUP BY label_sentiment, label_secondary, lang""",
)
def stored_report_inputs(t):
    """The corpus is parsed once, its store feeds the report."""
    folder = shared_dir(t.spark, "report")
    write_corpus(with_epoch_times(t.labelled), f"{folder}/corpus")
    write_table_csv(language_metrics(t, "x"), f"{folder}/base")
    write_table_csv(language_metrics(t, "y"), f"{folder}/embedded")
    schema = t.labelled.schema.simpleString()[7:-1].replace("timestamp_ntz", "string").replace(":", " ")
    store_report_inputs(t.spark, f"{folder}/corpus", f"{folder}/store", schema)
    inputs = load_stored_inputs(t.spark, f"{folder}/store", f"{folder}/base", f"{folder}/embedded")
    return inputs.posts.filter("full_text IS NOT NULL").groupBy("label_sentiment", "label_secondary", "lang").agg(
        F.count("*").alias("n"),
        F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_post"),
        inputs.base_metrics.agg(F.count("*")).scalar().alias("base_models"),
        inputs.embedding_metrics.agg(F.count("*")).scalar().alias("embedding_models"),
    )

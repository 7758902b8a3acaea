"""Curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SENSITIVE
from ..operators import curate as C
from ..operators.profile import assert_absent
from ..plans.curation import curate
from .registry import LABELLED, POSTS, query

# Documents beside their labels: most documents have none, so the label columns are sparse.
BESIDE = """beside AS (
  SELECT d.doc_id AS id, d.source AS name, d.lang, d.text AS full_text, l.quality,
         CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 1 END AS rare
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def beside(t):
    rare = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(1))
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("name"),
        "lang",
        F.col("text").alias("full_text"),
        "quality",
        rare.alias("rare"),
    )


@query(
    "cu1_drop_sparse_columns", f"WITH {BESIDE} SELECT id, name, lang, full_text, quality FROM beside"
)
def drop_sparse(t):
    return C.drop_sparse_columns(beside(t), 0.95)


@query("cu2_drop_sensitive", f"WITH {BESIDE} SELECT lang, full_text, quality, rare FROM beside")
def drop_sensitive(t):
    return C.drop_sensitive(beside(t))


@query("cu3_keep_language", "SELECT doc_id, lang, text FROM documents WHERE lang = 'es'")
def keep_language(t):
    return C.keep_language(t.documents).select("doc_id", "lang", "text")


@query(
    "cu4_dedup_keep_first",
    "SELECT doc_id, text, lang, source, n_chars FROM documents"
    " QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def dedup(t):
    return C.dedup_keep_first(t.documents, "text", ["doc_id"])


@query(
    "cu4_dedup_lines_by_newest",
    "SELECT user_id, event_id, event_type, (ts::VARCHAR)[:19] AS ts FROM events"
    " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
)
def dedup_events(t):
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    first = C.dedup_keep_first(rows, "user_id", ["ts", "event_id"])
    return first.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("cu5_drop_retweets", f"WITH {POSTS} SELECT id, full_text FROM posts WHERE NOT retweeted")
def drop_retweets(t):
    return C.drop_retweets(t.posts).select("id", "full_text")


@query(
    "cu6_hashed_id",
    f"""WITH {POSTS} SELECT id, sha256(coalesce(full_text ||
  CASE WHEN retweeted THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') END, 'nan')) AS tweet_id_hashed
FROM posts""",
)
def hashed_id(t):
    # Retweets get no date, so that the null rule is exercised too.
    day = F.when(F.col("retweeted"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    rows = t.posts.withColumn("created_at", day)
    return C.with_hashed_id(rows).select("id", "tweet_id_hashed")


CURATED = f"""{POSTS}, first_posts AS (
  SELECT * FROM posts WHERE lang = 'es'
  QUALIFY row_number() OVER (PARTITION BY full_text ORDER BY id) = 1),
curated AS (
  SELECT full_text, lang, source, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
         retweet_count,
         sha256(full_text || strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS tweet_id_hashed
  FROM first_posts WHERE NOT retweeted)"""


def raw_posts(t):
    """Posts in the shape of a raw export, with personal and almost empty columns."""
    return t.posts.select(
        "id",
        F.concat(F.lit("u"), "id").alias("screen_name"),
        F.when(F.col("n_chars") < 0, "x").alias("location_hint"),
        "full_text",
        "lang",
        "source",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "retweet_count",
        "retweeted",
    )


def curated_posts(t):
    return curate(raw_posts(t), ["id"])


@query("cu7_curate", f"WITH {CURATED} SELECT * FROM curated")
def curate_all(t):
    return curated_posts(t).drop("retweeted")


@query("cu8_select_existing", f"WITH {POSTS} SELECT (created_at::VARCHAR)[:19] AS created_at,"
       " source FROM posts")  # fmt: skip
def select_existing(t):
    rows = C.select_existing(t.posts, ["created_at", "clean_text", "source", "followers_count"])
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "cu9_filter_posts",
    f"""WITH {LABELLED} SELECT id, label_sentiment, hour(created_at) AS hour FROM labelled
WHERE label_sentiment IN ('positivo', 'neutro') AND hour(created_at) BETWEEN 6 AND 18""",
)
def filter_posts(t):
    rows = C.filter_posts(t.labelled, ["positivo", "neutro"], 6, 18)
    return rows.select("id", "label_sentiment", F.hour("created_at").cast("bigint").alias("hour"))


@query(
    "cu10_hour_bounds",
    "SELECT min(hour(ts)) AS hour_min, max(hour(ts)) AS hour_max FROM events",
)
def hour_bounds(t):
    return C.hour_bounds(t.events, "ts")


@query(
    "cu11_with_timestamp",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events
WHERE event_type <> 'signup'""",
)
def with_timestamp(t):
    """The event times spelled in every accepted way; the rest must be dropped."""
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ms = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) * 1000
    posted = F.concat(F.lit("Sun "), F.date_format("ts", "MMM dd HH:mm:ss '+0000' yyyy"))
    form = F.col("event_id") % 4
    spelled = (
        F.when(F.col("event_type") == "signup", "not a date")
        .when(form == 0, iso)
        .when(form == 1, ms.cast("string"))
        .when(form == 2, posted)
        .when(form == 3, F.concat(F.replace(iso, F.lit(" "), F.lit("T")), F.lit("+00:00")))
    )
    rows = C.with_timestamp(t.events.select("event_id", spelled.alias("created_at")))
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "pr11_assert_absent",
    f"WITH {CURATED} SELECT c AS \"column\", false AS present, n AS n_rows FROM"
    " (SELECT count(*) AS n FROM curated),"
    " (SELECT unnest(['id', 'name', 'screen_name', 'location']) AS c)",
)
def columns_gone(t):
    return assert_absent(curated_posts(t), SENSITIVE)

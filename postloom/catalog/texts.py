"""Text normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PreprocessConfig
from ..functions import patterns as P
from ..functions import text as X
from ..operators import heavy as HH
from ..operators import text as TX
from . import sqltext as S
from .registry import query, stored

# Noise that holds whole texts together: the documents with links, tags and emoji mixed in.
NOISY = f"noisy AS (SELECT doc_id, {S.noisy_sql('text')} AS full_text FROM documents)"
NOISY_LOW = f"noisy AS (SELECT doc_id, lower({S.noisy_sql('text')}) AS full_text FROM documents)"
CLEAN = f"{NOISY}, {S.cleaned_cte('noisy', 'full_text')}"


def noisy_documents(t):
    return t.documents.select("doc_id", S.noisy(F.col("text")).alias("full_text"))


def clean_documents(t):
    return TX.with_clean_text(noisy_documents(t)).select("doc_id", "clean_text")


def _scalar(name: str, function, sql: str, low: bool = True) -> None:
    """One text function over the noisy documents."""

    @query(name, f"WITH {NOISY_LOW if low else NOISY} SELECT doc_id, {sql} AS result FROM noisy")
    def build(t):
        rows = noisy_documents(t)
        text = F.lower("full_text") if low else F.col("full_text")
        return rows.select("doc_id", function(text).alias("result"))


@query("tx1_nfkc", "SELECT doc_id, text AS result FROM documents")
def nfkc(t):
    # The texts are in normal form already, so undoing full-width vowels gives them back.
    wide = F.translate("text", "aeiou", "ａｅｉｏｕ")
    return t.documents.select("doc_id", X.nfkc(wide).alias("result"))


_scalar("tx2_lower", F.lower, "lower(full_text)", low=False)
_scalar("tx3_strip_urls", X.strip_urls, S.urls_sql("full_text"))
_scalar("tx4_strip_mentions", X.strip_mentions, S.mentions_sql("full_text"))
_scalar("tx5_hashtags_normalize", X.hashtags, S.hashtags_sql("full_text"))
_scalar(
    "tx6_hashtags_remove",
    lambda c: X.hashtags(c, "remove"),
    S.hashtags_sql("full_text", "remove"),
)
_scalar("tx7_emoji_remove", lambda c: X.emojis(c, "remove"), S.emoji_removed_sql("full_text"))
_scalar("tx8_emoji_map", X.emojis, S.emoji_mapped_sql("full_text"))
_scalar("tx9_join_compounds", X.join_compounds, S.compounds_sql("full_text"))
_scalar("tx10_split_hyphens", X.split_hyphens, S.hyphens_sql("full_text"))
_scalar("tx11_squeeze", X.squeeze, S.squeeze_sql("full_text"))


@query("tx12_clean_text", f"WITH {CLEAN} SELECT doc_id, clean_text FROM cleaned")
def clean(t):
    return clean_documents(t)


@query(
    "tx12_clean_text_remove",
    f"WITH {NOISY}, {S.cleaned_cte('noisy', 'full_text', mode='remove')}"
    " SELECT doc_id, clean_text FROM cleaned",
)
def clean_remove(t):
    config = PreprocessConfig(emoji_strategy="remove")
    return TX.with_clean_text(noisy_documents(t), config).select("doc_id", "clean_text")


@query(
    "tx13_tokens",
    f"WITH {CLEAN} SELECT doc_id, array_to_string({S.tokens_sql('clean_text')}, '|') AS tokens"
    " FROM cleaned",
)
def tokens(t):
    rows = TX.with_tokens(clean_documents(t))
    return rows.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


# Forms and lemmas found in the texts themselves: a plural in -s stands for its singular.
LEMMAS = f"""words AS (
  SELECT DISTINCT unnest({S.tokens_sql('lower(text)')}) AS form FROM documents),
lemmas AS (
  SELECT w.form, b.form AS lemma FROM words w
  JOIN words b ON b.form = left(w.form, length(w.form) - 1) WHERE w.form LIKE '%s')"""


def lemma_table(t):
    listed = t.documents.select(F.explode(X.tokens(F.lower("text"))).alias("form"))
    words = stored(t, listed.distinct(), "words")
    cut = words.filter(F.col("form").endswith("s")).select(
        "form", F.expr("left(form, length(form) - 1)").alias("lemma")
    )
    return cut.join(words.select(F.col("form").alias("lemma")), "lemma")


LEMMAS_SQL = f"""WITH {CLEAN}, {LEMMAS}, exploded AS (
  SELECT doc_id, unnest(toks) AS form, generate_subscripts(toks, 1) AS pos
  FROM (SELECT doc_id, {S.tokens_sql('clean_text')} AS toks FROM cleaned)),
grouped AS (
  SELECT doc_id, string_agg(coalesce(lemma, e.form), '|' ORDER BY pos) AS tokens
  FROM exploded e LEFT JOIN lemmas l ON l.form = e.form GROUP BY doc_id)
SELECT c.doc_id, coalesce(g.tokens, '') AS tokens
FROM cleaned c LEFT JOIN grouped g ON g.doc_id = c.doc_id"""


@query("tx14_lemmas", LEMMAS_SQL)
def lemmas(t):
    docs = stored(t, clean_documents(t), "clean")
    out = TX.with_lemmas(TX.with_tokens(docs), lemma_table(t))
    return out.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query("tx14_lemmas_large_table", LEMMAS_SQL)
def lemmas_large(t):
    # The operator reads its rows once, into blocks that it stores.
    docs = TX.with_tokens(clean_documents(t)).select("doc_id", "tokens")
    out = TX.with_lemmas(docs, lemma_table(t), row_bytes=0, max_bytes=0)
    return out.select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query(
    "tx15_extract_hashtags",
    f"""WITH {NOISY} SELECT doc_id,
  array_to_string(regexp_extract_all(full_text, {S.quote(P.HASHTAG)}), ' ') AS hashtags
FROM noisy""",
)
def extract_hashtags(t):
    rows = TX.with_hashtags(noisy_documents(t))
    return rows.select("doc_id", F.array_join("extracted_hashtags", " ").alias("hashtags"))


@query(
    "tx16_top_hashtags",
    f"""WITH {NOISY}, tags AS (
  SELECT unnest(regexp_extract_all(full_text, {S.quote(P.HASHTAG)})) AS hashtag FROM noisy)
SELECT hashtag, count(*) AS n FROM tags GROUP BY hashtag ORDER BY n DESC, hashtag LIMIT 10""",
)
def top_hashtags(t):
    return TX.top_hashtags(noisy_documents(t))


@query(
    "tx16_top_hashtags_bounded",
    f"""WITH {NOISY}, tags AS (
  SELECT unnest(regexp_extract_all(full_text, {S.quote(P.HASHTAG)})) AS hashtag FROM noisy)
SELECT hashtag, count(*) AS n FROM tags GROUP BY hashtag ORDER BY n DESC, hashtag LIMIT 10""",
)
def top_hashtags_bounded(t):
    return HH.top_hashtags(noisy_documents(t))


MEDIA = f"""media AS (SELECT doc_id, contains(full_text, 'pic.twitter.com') AS has_image,
  contains(lower(full_text), 'video') OR contains(lower(full_text), 'youtu') AS has_video
FROM noisy)"""


@query("tx17_media_flags", f"WITH {NOISY}, {MEDIA} SELECT * FROM media")
def media_flags(t):
    return TX.with_media_flags(noisy_documents(t)).select("doc_id", "has_image", "has_video")


@query(
    "tx18_media_counts",
    f"WITH {NOISY}, {MEDIA} SELECT count(*) FILTER (has_image) AS with_image,"
    " count(*) FILTER (has_video) AS with_video FROM media",
)
def media_counts(t):
    return TX.media_counts(noisy_documents(t))


@query(
    "tx19_truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 220 THEN left(text, 220) || '...' ELSE text END"
    " AS shown, length(text) AS full_length FROM documents",
)
def truncate(t):
    return t.documents.select(
        "doc_id",
        X.truncate_text(F.col("text")).alias("shown"),
        F.length("text").cast("bigint").alias("full_length"),
    )


@query(
    "tx20_cap_text",
    "SELECT doc_id, left(text, 512) AS capped, text AS uncapped FROM documents",
)
def cap(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", X.cap_text(text, 512).alias("capped"), X.cap_text(text).alias("uncapped")
    )

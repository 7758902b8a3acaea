"""The operators of this subpackage as queries over the supplied tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, decontaminate, filter_audit, language_id, lm_score, near_dedup, order_minhash, packing, quality, resample,
    secrets, substring_dedup, suffix_dedup,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_masked_lm": op1,
    "op2_decontaminate": op2,
    "op3_language_id": op3,
    "op4_secrets": op4,
    "op5_order_minhash": op5,
    "op6_near_dedup": op6,
    "op7_packing": op7,
    "op8_quality": op8,
    "op9_substring_dedup": op9,
    "op10_suffix_array_dedup": op10,
    "op11_resample": op11,
    "op12_bpe": op12,
    "op13_filter_audit": op13,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = f"regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The bits of one byte in a CRC-32: its polynomial, lowest bit first.
_CRC_BITS = "list_reduce(repeat([0::UBIGINT], 8), lambda s, k: xor(s >> 1, 3988292384::UBIGINT * (s & 1)), xor(c, x))"
_UPPER = "length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))"

SQL: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
hits AS (
  SELECT doc_id, i, bw.n, item_id
  FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS r(i), bw
  WHERE bw.n = sizes.n AND bw.win = array_to_string(w[i:i + sizes.n - 1], ' ')),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(w[i:i + least(5, len(w)) - 1]) AS h
  FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM wins),
gone AS (SELECT DISTINCT doc_id, p FROM judged, unnest(range(i, i + 13)) AS u(p) WHERE hit),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) AS o
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_resample": f"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT {_PLAIN_WORDS} AS w FROM benchmark),
found AS (
  SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (
    SELECT unnest(w) AS word, 1 AS s, 0 AS t FROM d UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY word),
bytes AS (
  SELECT *, list_transform(range(0, strlen(word)),
    lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::UBIGINT) AS l FROM found),
hashed AS (
  SELECT *, xor(list_reduce(l, lambda c, x: {_CRC_BITS}, 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket
  FROM bytes),
total AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM hashed),
gains AS (
  SELECT bucket, floor(1000 * ln((sum(t) + 1) * (any_value(all_s) + 10000)
    / ((sum(s) + 1) * (any_value(all_t) + 10000))))::BIGINT AS gain FROM hashed, total GROUP BY bucket),
weights AS (
  SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 *
    ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)""",
    "op13_filter_audit": f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
masks AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * ({_UPPER}) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN l USING (doc_id) GROUP BY part, mask),
letters AS (SELECT substr('ABCDE', i + 1, 1) AS f, 1 << i AS bit FROM range(5) AS r(i)),
orders AS (
  SELECT a.f || b.f || c.f || e.f || g.f AS filter_order
  FROM letters a, letters b, letters c, letters e, letters g
  WHERE a.bit | b.bit | c.bit | e.bit | g.bit = 31),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bit,
         (SELECT coalesce(sum(p.bit), 0)::INT FROM letters p WHERE instr(left(filter_order, s - 1), p.f) > 0) AS before
  FROM orders, range(1, 6) AS r(s), letters WHERE f = substr(filter_order, s, 1)),
sums AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM sums""",
}

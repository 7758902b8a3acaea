"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PR
from ..operators.curate import dedup_keep_first, keep_language
from .registry import POSTS, query, stored



@query(
    "pr1_preview",
    "SELECT doc_id, lang, source, text FROM documents ORDER BY doc_id LIMIT 5",
)
def preview(t):
    return PR.preview(t.documents.select("doc_id", "lang", "source", "text"), ["doc_id"])


@query(
    "pr2_describe_schema",
    """SELECT c AS "column", ty AS type, n AS n_rows FROM (SELECT count(*) AS n FROM documents),
(VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'),
        ('n_chars', 'bigint')) AS v(c, ty)""",
)
def describe_schema(t):
    return PR.describe_schema(t.documents)


def _number_sql(table: str, col: str) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont({col}::DOUBLE, {p}), 6) AS {n}"
        for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
    )
    return f"""SELECT '{col}' AS "column", count({col}) AS count, NULL::BIGINT AS "unique",
  NULL::VARCHAR AS top, NULL::BIGINT AS freq, round(avg({col}), 4) AS mean,
  round(stddev_samp({col}), 4) AS std, min({col})::DOUBLE AS min, {quartiles},
  max({col})::DOUBLE AS max FROM {table}"""


def _time_sql(table: str, col: str) -> str:
    """A date or time as epoch seconds."""
    seconds = f"(SELECT epoch({col}::TIMESTAMP) AS {col} FROM {table})"
    return _number_sql(seconds, col)


def _word_sql(table: str, col: str) -> str:
    empty = ", ".join(
        f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "p25", "p50", "p75", "max")
    )
    return f"""SELECT '{col}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq, {empty}
  FROM (SELECT {col} AS v, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1)"""


def _rounded(df):
    places = {"mean": 4, "std": 4, "p25": 6, "p50": 6, "p75": 6}
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(
    "pr3_describe_all",
    " UNION ALL ".join(
        [
            _number_sql("orders", "o_orderkey"),
            _number_sql("orders", "o_custkey"),
            _word_sql("orders", "o_orderstatus"),
            _number_sql("orders", "o_totalprice"),
            _time_sql("orders", "o_orderdate"),
            _word_sql("orders", "o_orderpriority"),
        ]
    ),
)
def describe_all(t):
    return _rounded(PR.describe_all(t.orders))


@query(
    "pr3_describe_posts",
    " UNION ALL ".join(
        [
            _number_sql("documents", "doc_id"),
            _number_sql("documents", "n_chars"),
            _word_sql("documents", "text"),
            _word_sql("documents", "lang"),
            _word_sql("documents", "source"),
        ]
    ),
)
def describe_posts(t):
    return _rounded(PR.describe_all(t.documents))


MARKED = """marked AS (
  SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, l.toxic, nullif(d.source, 'src3') AS source
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
MARKED_COLUMNS = ("doc_id", "text", "lang", "n_chars", "quality", "toxic", "source")


def marked(t):
    source = F.nullif(F.col("source"), F.lit("src3")).alias("source")
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select("doc_id", "text", "lang", "n_chars", "quality", "toxic", source)


def _each(measure: str, name: str) -> str:
    return f"WITH {MARKED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {measure.format(c=c)} AS {name} FROM marked"
        for c in MARKED_COLUMNS
    )


@query("pr4_null_counts", _each("count(*) FILTER ({c} IS NULL)", "nulls"))
def null_counts(t):
    return PR.null_counts(marked(t))


@query("pr5_null_ratios", _each("round(avg(({c} IS NULL)::INT), 9)", "ratio"))
def null_ratios(t):
    return PR.null_ratios(marked(t)).withColumn("ratio", F.round("ratio", 9))


@query(
    "pr6_null_patterns",
    f"""WITH {MARKED} SELECT
  {" || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in MARKED_COLUMNS)} AS pattern,
  count(*) AS n FROM marked GROUP BY 1""",
)
def null_patterns(t):
    return PR.null_patterns(marked(t))


@query(
    "pr6_null_matrix",
    f"""WITH {MARKED}, numbered AS (
  SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) * 100 // count(*) OVER () AS bin FROM marked)
"""
    + " UNION ALL ".join(
        f"SELECT bin::INT AS bin, '{c}' AS \"column\", round(avg(({c} IS NULL)::INT), 9) AS ratio FROM numbered GROUP BY bin"
        for c in MARKED_COLUMNS
    ),
)
def null_matrix(t):
    return PR.null_matrix(marked(t), ["doc_id"]).withColumn("ratio", F.round("ratio", 9))


@query(
    "pr7_counts_on_the_way",
    """SELECT 'read' AS stage, count(*) AS n FROM documents
UNION ALL SELECT 'spanish', count(*) FILTER (lang = 'es') FROM documents
UNION ALL SELECT 'distinct', count(DISTINCT text) FILTER (lang = 'es') FROM documents""",
)
def counts_on_the_way(t):
    counts = PR.CountsOnTheWay()
    spanish = counts.mark(keep_language(counts.mark(t.documents, "read")), "spanish")
    stored(t, counts.mark(dedup_keep_first(spanish, "text", ["doc_id"]), "distinct"), "curated")
    return counts.table(t.spark)


@query(
    "pr7_stage_counts",
    f"""WITH {POSTS}, one AS (SELECT count(*) AS read, count(*) FILTER (lang = 'es') AS spanish,
  count(*) FILTER (lang = 'es' AND NOT retweeted) AS original FROM posts)
SELECT 'read' AS stage, read AS n FROM one UNION ALL SELECT 'spanish', spanish FROM one
UNION ALL SELECT 'original', original FROM one""",
)
def stage_counts(t):
    spanish = F.col("lang") == "es"
    stages = {"read": F.lit(True), "spanish": spanish, "original": spanish & ~F.col("retweeted")}
    return PR.stage_counts(t.posts, stages)


@query(
    "pr7_stage_counts_of_tables",
    """SELECT 'read' AS stage, count(*) AS n FROM documents
UNION ALL SELECT 'distinct', count(DISTINCT text) FROM documents""",
)
def stage_counts_of_tables(t):
    first = dedup_keep_first(t.documents, "text", ["doc_id"])
    return PR.counts_of({"read": t.documents, "distinct": first})


@query("pr8_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(t):
    return PR.value_counts(t.documents, "lang")


@query(
    "pr9_text_length",
    "SELECT doc_id, length(text) AS tweet_length FROM documents",
)
def text_length(t):
    return PR.with_length(t.documents, "text").select("doc_id", "tweet_length")


@query(
    "pr9_mean_length", "SELECT round(avg(length(text)), 6) AS mean_length FROM documents"
)
def mean_length(t):
    return PR.mean_length(t.documents, "text").withColumn(
        "mean_length", F.round("mean_length", 6)
    )


@query(
    "pr10_length_histogram",
    """WITH l AS (SELECT length(text)::DOUBLE AS x FROM documents),
span AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM l),
counts AS (SELECT least(floor((x - lo) / w), 29)::INT AS bin, count(*) AS n FROM l, span GROUP BY 1)
SELECT b.bin, round(lo + b.bin * w, 6) AS left_edge, round(lo + (b.bin + 1) * w, 6) AS right_edge,
  coalesce(n, 0) AS n
FROM (SELECT unnest(range(30))::INT AS bin) b CROSS JOIN span LEFT JOIN counts c ON c.bin = b.bin""",
)
def length_histogram(t):
    rows = PR.equal_width_histogram(PR.with_length(t.documents, "text"), "tweet_length")
    return rows.withColumns({c: F.round(c, 6) for c in ("left_edge", "right_edge")})

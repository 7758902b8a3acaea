"""Queries that write data derived from the supplied tables and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PreprocessConfig
from ..operators.curate import dedup_keep_first
from ..session import shared_dir
from ..sources import corpus, delimited, fingerprint, runlog, split_csv
from ..sources.delimited import NULL_WORDS
from . import sqltext as S
from .registry import LABELLED, POSTS, query
from .reports import METRICS, language_metrics

NULL_LIST = ", ".join(S.quote(w) for w in NULL_WORDS)


RAGGED = f"""SELECT doc_id, CASE WHEN text NOT IN ({NULL_LIST}) THEN text END AS text,
  CASE WHEN n_chars % 4 <> 0 THEN lang END AS lang
FROM documents WHERE n_chars % 4 < 2"""


def ragged_lines(t) -> str:
    """A folder of lines with two, three, four or five fields under a three-column schema."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    width = F.col("n_chars") % 4
    line = F.concat_ws(
        ",",
        F.col("doc_id").cast("string"),
        quoted,
        F.when(width > 0, F.col("lang")),
        F.when(width == 2, F.lit("")),
        F.when(width == 3, F.lit('"a,b",x')),
    )
    path = shared_dir(t.spark, "raw")
    t.documents.select(line.alias("value")).write.text(path)
    return path


@query("io1_read_raw_csv", RAGGED)
def read_raw_csv(t):
    schema = "doc_id bigint, text string, lang string"
    return delimited.read_raw_csv(t.spark, ragged_lines(t), schema, header=False, multi_line=True)


@query("io1_read_split_csv", RAGGED)
def read_split_csv(t):
    """The same files, each read by as many tasks as it has byte ranges."""
    return split_csv.read_split_csv(t.spark, ragged_lines(t), "doc_id bigint, text string, lang string", header=False)


@query(
    "cu4_dedup_file_order",
    """SELECT arg_min(doc_id, (n_chars, doc_id)) AS doc_id, head FROM (
  SELECT *, left(text, 12) || chr(10) || source AS head FROM documents) GROUP BY head""",
)
def dedup_file_order(t):
    """Of posts with one beginning and source, the first in the files; the beginning holds a line break."""
    head = F.concat(F.expr("left(text, 12)"), F.lit("\n"), "source")
    rows = t.documents.select("n_chars", "doc_id", head.alias("head"))
    quoted = F.concat(F.lit('"'), F.replace("head", F.lit('"'), F.lit('""')), F.lit('"'))
    path = shared_dir(t.spark, "ordered")
    ordered = rows.repartitionByRange("n_chars", "doc_id").sortWithinPartitions("n_chars", "doc_id")
    ordered.select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted).alias("value")).write.text(path)
    found = split_csv.read_split_csv(t.spark, path, "doc_id bigint, head string", header=False, position="place")
    return dedup_keep_first(found, "head", ["place"]).drop("place")


@query(
    "io2_nullify",
    """SELECT doc_id, CASE WHEN lang NOT IN ('fr', 'de') THEN lang END AS lang,
  CASE WHEN source <> 'src1' THEN source END AS source FROM documents""",
)
def nullify(t):
    spelled = F.when(F.col("lang") == "fr", "NA").when(F.col("lang") == "de", "null")
    rows = t.documents.select(
        "doc_id",
        spelled.otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("source"),
    )
    return delimited.nullify(rows)


@query(
    "io3_read_corpus",
    f"""WITH {POSTS} SELECT id, full_text, lang, source, n_chars,
  epoch_us(created_at) // 1000 AS created_at, retweet_count, favorite_count, retweeted FROM posts""",
)
def read_corpus(t):
    path = shared_dir(t.spark, "corpus")
    rows = corpus.with_epoch_times(t.posts)
    corpus.write_corpus(rows, path)
    return corpus.read_corpus(t.spark, path, rows.schema)


@query("io4_read_metrics", f"WITH {LABELLED}, {METRICS} SELECT model, precision, recall, f1 FROM metrics"
       " WHERE k = 'x'")  # fmt: skip
def read_metrics(t):
    path = shared_dir(t.spark, "metrics")
    delimited.write_table_csv(language_metrics(t, "x"), path)
    return delimited.read_metrics(t.spark, path)


@query(
    "io5_write_corpus",
    """SELECT count(*) AS n_lines, count(*) FILTER (lang = 'fr') AS with_null,
  sum(length(text))::BIGINT AS n_letters FROM documents""",
)
def write_corpus(t):
    path = shared_dir(t.spark, "corpus")
    rows = t.documents.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    corpus.write_corpus(rows, path)
    lines = t.spark.read.text(path)
    letters = F.length(F.get_json_object("value", "$.text"))
    return lines.agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("value").contains('"lang":null')).alias("with_null"),
        F.sum(letters).alias("n_letters"),
    )


@query("io6_write_table_csv", "SELECT doc_id, text, '' AS label_manual FROM documents")
def write_table_csv(t):
    path = shared_dir(t.spark, "sheet")
    delimited.write_table_csv(
        t.documents.select("doc_id", "text", F.lit("").alias("label_manual")), path
    )
    stored = t.spark.read.csv(
        path,
        schema="doc_id bigint, text string, label_manual string",
        header=True,
        multiLine=True,
        escape='"',
    )
    return stored.na.fill("", ["label_manual"])


DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _cell_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(length({text}) || '=' || {text}, '-')"


@query(
    "io7_dataset_fingerprint",
    f"""WITH h AS (SELECT sha256({" || ".join(_cell_sql(c) for c in sorted(DOCUMENT_COLUMNS))}) AS d FROM documents)
SELECT count(*) AS n_rows, sum(('0x' || left(d, 8))::UBIGINT)::VARCHAR || ':' ||
  sum(('0x' || substr(d, 9, 8))::UBIGINT)::VARCHAR AS fingerprint FROM h""",
)
def dataset_fingerprint(t):
    return fingerprint.dataset_fingerprint(t.documents)


@query(
    "io8_run_log",
    """SELECT 'Total records' AS key, count(*)::VARCHAR AS value FROM documents
UNION ALL SELECT * FROM (VALUES ('Sample size', '500'), ('Random seed', '42'),
  ('Lemmatization', 'False'), ('Emoji strategy', 'map'), ('Hashtag strategy', 'normalize'),
  ('Label strategy', 'both'))""",
)
def run_log(t):
    return runlog.run_log(t.documents, PreprocessConfig())

"""Delimited text: raw exports, metrics tables, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that stand for a missing value in a raw export.
NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

METRICS_SCHEMA = "model string, precision double, recall double, f1 double"


def nullify(
    df: DataFrame, words: Sequence[str] = NULL_WORDS, cols: Sequence[str] | None = None
) -> DataFrame:
    """Turn the missing-value spellings in string columns into nulls."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen = [c for c in strings if cols is None or c in cols]
    return df.withColumns({c: F.when(~F.col(c).isin(*words), F.col(c)) for c in chosen})


def read_raw_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    multi_line: bool = False,
    header: bool = True,
) -> DataFrame:
    """Read a UTF-8 export with a header: short rows are padded, rows with too many fields dropped.

    Fields are read as text, missing-value spellings become nulls, and each column is then cast to
    its declared type (a value that does not fit becomes null). A quoted field may hold line
    breaks only with ``multi_line``, which makes each file one task; ``split_csv.read_split_csv``
    reads such files by many tasks. Without either, a quote that is open at the end of a line shows
    up as rows cut short.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "__malformed"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared])
    raw = spark.read.csv(
        path,
        schema=text.add(bad, T.StringType()),
        header=header,
        sep=sep,
        quote='"',
        escape='"',
        encoding="UTF-8",
        mode="PERMISSIVE",
        multiLine=multi_line,
        columnNameOfCorruptRecord=bad,
        enforceSchema=True,
    )
    return declared_columns(raw, declared, sep, bad)


def declared_columns(
    raw: DataFrame, declared: T.StructType, sep: str, bad: str, kept: Sequence[str] = ()
) -> DataFrame:
    """Rows without too many fields, their spellings of null as nulls, with the declared types.

    ``bad`` has the whole record where its number of fields is not the declared one.
    """
    # Spark reports both short and long rows as malformed; separators outside quotes tell them apart.
    bare = F.regexp_replace(bad, '"(?:[^"]|"")*+"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # Spark refuses to read the malformed column alone, so the test also names a column; it adds 0.
    first = F.least(F.coalesce(F.length(declared[0].name), F.lit(0)), F.lit(0))
    fits = F.coalesce(fields, F.lit(0)) <= first + len(declared)
    names = nullify(raw.filter(fits).drop(bad), cols=[f.name for f in declared])
    return names.select(*kept, *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in declared])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=METRICS_SCHEMA, header=True)


def write_table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a sheet with a header; quotes inside fields are doubled, arrays become JSON text."""
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    df.withColumns({c: F.to_json(c) for c in lists}).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")

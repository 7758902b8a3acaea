"""Quoted CSV with line breaks inside fields, read by many tasks.

Spark cuts files into byte ranges at line ends, and a line end may lie inside a quoted field. Quotes are
doubled inside fields, so a line end lies inside one exactly if an odd number of quotes stands before
it in the file. A first pass counts the quotes of each range; a sum over the ranges before it tells
how each range begins. In a second pass each range puts its own lines together to records. Only the
pieces of records that reach over a range's end are brought together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .delimited import declared_columns, read_raw_csv

#: Ranges that begin inside a field are named to all tasks, up to this number; with more, files are
#: read whole, one task each.
MAX_OPEN_RANGES = 200_000
_PIECE = "file string, block bigint, at bigint, whole boolean, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.text(path, lineSep="\n").select(*place, "value")


def open_ranges(lines: DataFrame, quote: str = '"') -> DataFrame:
    """``(file, block)`` of the ranges that begin inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    ranges = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    # One row per range.
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("before", before).filter(F.pmod("before", F.lit(2)) == 1).select("file", "block")


def _pieces(lines: DataFrame, opened: set[tuple[str, int]], quote: str) -> DataFrame:
    """Records that lie in one range, and the pieces of others: a range's first lines (``at`` 0) and last ones.

    Whole records are numbered from 1 within their range.
    """
    shared = lines.sparkSession.sparkContext.broadcast(opened)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, inside, at, out = None, [], False, 0, []

        def close(whole: bool) -> None:
            nonlocal held
            out.append((*place, at, whole, "\n".join(held)))
            held = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "at", "whole", "value"]
            )

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != place:
                    if held:
                        close(False)
                    place = file, block
                    inside = place in shared.value
                    at = 0 if inside else 1
                held.append(line)
                if line.count(quote) % 2:
                    inside = not inside
                if not inside:
                    close(at > 0)
                    at += 1
            yield batch_of()
        if held:
            close(False)
            yield batch_of()

    return lines.mapInArrow(run, _PIECE)


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame | None:
    """Rows ``(file, block, at, value)``, one per record, or None if too many ranges begin inside a field."""
    lines = _lines(spark, path)
    found = open_ranges(lines, quote).limit(MAX_OPEN_RANGES + 1).collect()
    if len(found) > MAX_OPEN_RANGES:
        return None
    pieces = _pieces(lines, {tuple(r) for r in found}, quote)
    if not found:
        return pieces.select("file", "block", "at", "value")
    whole = pieces.filter("whole").select("file", "block", "at", "value")
    # At most two pieces per range: a record's begins with the last piece of a range.
    order = Window.partitionBy("file").orderBy("block", "at")
    chain = F.sum((F.col("at") > 0).cast("int")).over(order)
    parts = pieces.filter("NOT whole").withColumn("chain", chain).groupBy("file", "chain")
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p")).select(
        "file",
        F.col("p")[0]["block"].alias("block"),
        F.col("p")[0]["at"].alias("at"),
        F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"),
    )
    return whole.unionByName(joined)


def read_split_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    header: bool = True,
    position: str | None = None,
) -> DataFrame:
    """The rows of ``read_raw_csv(..., multi_line=True)``, but each file is read by many tasks.

    ``position`` names a column with the record's place in the input: file, byte range and number,
    in the order of the files' names and lines. It can be used as ``order_by``.
    """
    found = records(spark, path)
    if found is None:
        if position:
            raise ValueError("too many byte ranges begin inside a quoted field to keep the order of the records")
        return read_raw_csv(spark, path, schema, sep, True, header)
    if header:
        found = found.filter((F.col("block") > 0) | (F.col("at") > 1))
    value = F.regexp_replace("value", "\r$", "")
    found = found.withColumn("value", value).filter("value <> ''")
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "__malformed"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared]).add(bad, T.StringType())
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "multiLine": "true"}
    parsed = found.select(
        F.struct("file", "block", "at").alias("__position"),
        F.from_csv("value", text.simpleString()[7:-1].replace(":", " "), options).alias("r"),
    ).select("__position", "r.*")
    rows = declared_columns(parsed, declared, sep, bad, ["__position"])
    return rows.withColumnRenamed("__position", position) if position else rows.drop("__position")

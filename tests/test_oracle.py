"""Every query with an SQL equivalent gives the same rows in DuckDB."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import ROOT, connect, difference

FOLDER = f"{ROOT}/sf0.01"
# Many passes, or tested on their own: these run at the smallest scale here.
SLOW, SMALLEST = ("ml3", "ml6", "op", "pipeline"), f"{ROOT}/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


def folder_of(name):
    return SMALLEST if name.startswith(SLOW) else FOLDER


@pytest.fixture(scope="module")
def con():
    return {folder: connect(folder) for folder in (FOLDER, SMALLEST)}


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    folder = folder_of(name)
    assert difference(QUERIES[name](spark, folder), SQL[name], con[folder]) is None
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_reads_the_whole_table(spark, name):
    """Queries beyond SQL have tests of their own; here each gives at least a row per row of its table."""
    rows = QUERIES[name](spark, folder_of(name))
    table = "embeddings" if name.startswith(("ml2", "ml3", "io9")) else "documents"
    whole = spark.read.parquet(f"{folder_of(name)}/{table}.parquet").count()
    few = name == "pipeline" or name.startswith("ml6")
    assert rows.select(rows.columns[0]).count() >= (1 if few else whole)
    spark.catalog.clearCache()


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r["total"], r["term"]))

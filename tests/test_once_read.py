"""Queries that make their texts once and shuffle no more than they need."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from postloom.catalog import labels, texts
from postloom.catalog.registry import Tables
from postloom.operators import blocks, bounded
from postloom.operators import features as FE
from postloom.operators import label as LB
from postloom.operators import text as TX

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_filter_repeats_the_cleaning(spark):
    clean = plan(texts.clean_documents(Tables(spark, FOLDER)))
    counts = plan(E.queries()["fe1_term_counts"](spark, FOLDER))
    assert counts.count("RLIKE") == clean.count("RLIKE")


def test_counts_of_texts_without_terms(spark):
    rows = spark.createDataFrame([(1, "ab ab c"), (2, ""), (3, None), (None, "! x"), (1, "ab")], "id int, clean_text string")
    assert sorted(map(tuple, FE.term_counts(rows, "id").collect())) == [(1, "ab", 1), (1, "ab", 2)]


@pytest.mark.parametrize("name", ["fe3_tfidf", "fe3_tfidf_vectors"])
def test_clean_texts_are_read_back(spark, name):
    assert "RLIKE" not in plan(E.queries()[name](spark, FOLDER))




def test_stratified_sample_moves_no_texts(spark):
    rows = E.queries()["sa2_stratified_sample"](spark, FOLDER)
    read = rows._jdf.queryExecution().executedPlan().toString()
    assert "doc_id:bigint" in read and "text:string" not in read


def test_labels_are_joined_before_words_are_listed(spark):
    found = plan(labels.learnt_lexicon(Tables(spark, FOLDER)))
    assert found.index("Generate") < found.index("Join")


def test_words_of_the_lemmas_are_listed_once(spark):
    assert "regexp_extract_all" not in plan(texts.lemma_table(Tables(spark, FOLDER)))


@pytest.mark.parametrize("row_bytes", [0, 2**20])
def test_lookup_tables_are_made_once(spark, monkeypatch, row_bytes):
    measured, measure = [], bounded.table_bytes
    monkeypatch.setattr(bounded, "table_bytes", lambda table: measured.append(plan(table)) or measure(table))
    df = spark.createDataFrame([(1, "cats and dogs cats"), (2, ""), (3, None)], "id int, clean_text string")
    forms = spark.createDataFrame([("cats", "cat"), ("cats", "katze"), ("dogs", "dog"), (None, "x")], "form string, lemma string")
    lemmas = TX.with_lemmas(TX.with_tokens(df), forms, row_bytes=row_bytes).collect()
    assert {r.id: r.tokens for r in lemmas} == {1: ["cat", "and", "dog", "cat"], 2: [], 3: None}
    weights = spark.createDataFrame([("cats", 2), ("cats", 3), ("dogs", -1)], "word string, weight int")
    hits = LB.with_table_hits(df, weights, row_bytes=row_bytes).collect()
    assert {r.id: (r.pos, r.neg) for r in hits} == {1: (4, 1), 2: (0, 0), 3: (0, 0)}
    assert measured and not any("Aggregate" in found for found in measured)


def test_each_form_of_a_block_is_joined_once(spark, monkeypatch):
    # F1 (tx14_lemmas_large_table): each token was a shuffled row, beside all tokens of its row.
    joined, join = [], TX.lookup_join
    monkeypatch.setattr(TX, "lookup_join", lambda df, *a, **b: joined.append(df.count()) or join(df, *a, **b))
    words = F.expr("transform(sequence(1, 500), x -> concat('w', x % 40))").alias("tokens")
    table = spark.createDataFrame([("w1", "one"), ("w39", "last"), ("v", "none")], "form string, lemma string")
    out = TX.with_lemmas(spark.range(200).coalesce(2).select("id", words), table, row_bytes=0, max_bytes=0)
    want = [{1: "one", 39: "last"}.get(x % 40, f"w{x % 40}") for x in range(1, 501)]
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(200)) and all(r.tokens == want for r in rows)
    assert max(joined) <= 2 * 40


@pytest.mark.parametrize("out", ["tokens", "TOKENS", "lemmas"])
def test_lemmas_beside_other_columns(spark, out):
    when = datetime.datetime(2022, 12, 11, 18)
    kinds = "at timestamp, tokens array<string>, more struct<a: array<int>, b: map<string, double>>, raw binary, none void"
    rows = [
        (when, ["gatos", None, "x", "gatos"], ([1, None], {"k": 1.5}), b"\x00", None),
        (None, [], (None, None), None, None),
        (when, None, None, b"", None),
        (when, ["", "", "perros", "𝒜s"], ([], {}), b"x", None),
    ]
    df = spark.createDataFrame([r for r in rows for _ in range(3)], kinds)
    table = spark.createDataFrame([("gatos", "gato"), ("", "blank"), ("𝒜s", "𝒜"), ("perros", None)], "form string, lemma string")
    forms = {"gatos": "gato", "": "blank", "𝒜s": "𝒜"}
    found = TX.with_lemmas(df, table, out=out, row_bytes=0, max_bytes=0)
    place = 5 if out == "lemmas" else 1
    want = []
    for row in df.collect():
        lemmas = None if row[1] is None else [forms.get(w, w) for w in row[1]]
        want.append((*row[:place], lemmas, *row[place + 1 :]))
    assert found.columns == [*df.columns[:place], out, *df.columns[place + 1 :]]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("size", [1, 200, 2**20])
def test_blocks_of_any_size_give_their_rows_back(spark, size):
    lists = F.when(F.col("id") % 7 > 0, F.expr("transform(sequence(1, id % 9 + 1), x -> concat('w', x * id % 23))"))
    df = spark.range(0, 300, numPartitions=3).select("id", lists.alias("l"), (F.col("id") % 5).cast("string").alias("s"))
    whole = blocks.packed(df, "l", size)
    sets = [r.forms for r in whole.collect()]
    assert all(len(set(s)) == len(s) for s in sets) and len(sets) == (3 if size == 2**20 else len(sets)) and (size > 1 or len(sets) == 300)
    found = F.transform(F.filter(F.sequence(F.lit(0), F.size("forms") - 1), lambda i: F.get("forms", i) == "w1"), lambda i: F.struct(i.alias("at"), F.lit("one").alias("lemma")))
    back = blocks.unpacked(whole.withColumn("found", F.when(F.size("forms") > 0, found)), df.schema, "l")
    want = df.withColumn("l", F.expr("transform(l, x -> if(x = 'w1', 'one', x))"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_shuffle_files_of_stored_tables_are_freed(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        tops = manager.localDirsString()
        return {n for top in tops for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}

    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = files()
    stored = bounded.stored_once(counts, "counts")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and stored.count() == 10

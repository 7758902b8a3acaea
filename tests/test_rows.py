"""Row numbers, the matrix of nulls, and counts that ride on a write."""

import random

from postloom.operators.curate import dedup_keep_first, keep_language
from postloom.operators.profile import CountsOnTheWay, null_matrix
from postloom.operators.rows import with_row_number


def test_numbers_are_those_of_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i, None if i % 3 else "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(7)
    got = with_row_number(df, ["a", "b"], "at").collect()
    assert sorted((r.at, r.a, r.b, r.c) for r in got) == [(i, *r) for i, r in enumerate(sorted(rows, key=lambda r: r[:2]))]
    tied = with_row_number(df, ["a"], "at").collect()
    assert sorted(r.at for r in tied) == list(range(1000))
    assert [r.a for r in sorted(tied, key=lambda r: r.at)] == sorted(r[0] for r in rows)
    assert with_row_number(df.limit(0), ["a"]).count() == 0


def test_matrix(spark):
    rows = [(i, None if i < 30 else "x", None if i % 2 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, bin string, ratio int").repartition(5)
    got = {(r["bin"], r["column"]): r["ratio"] for r in null_matrix(df, ["id"], 10).collect()}
    assert got == {(b, c): x for b in range(10) for c, x in (("id", 0.0), ("bin", float(b < 3)), ("ratio", 0.5))}
    assert null_matrix(df.limit(0), ["id"]).count() == 0
    few = null_matrix(df.limit(3), ["id"], 10).select("bin").distinct().count()
    assert few == 3


def test_counts_need_no_job_of_their_own(spark, tmp_path):
    rows = [(i, f"t{i % 40}", "es" if i % 4 else "en") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, full_text string, lang string")
    counts = CountsOnTheWay()
    kept = dedup_keep_first(counts.mark(keep_language(counts.mark(df, "read")), "spanish"), "full_text", ["id"])
    spark.sparkContext.setJobGroup("counting", "counting")
    counts.mark(kept, "distinct").write.parquet(str(tmp_path / "out"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counting"))
    table = counts.table(spark)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counting")) == jobs
    assert {r.stage: r.n for r in table.collect()} == {"read": 200, "spanish": 150, "distinct": 30}

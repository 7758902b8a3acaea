"""Frequent values by bounded summaries against plain counts."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.operators import heavy


def zipf(n, seed):
    rng = random.Random(seed)
    return [f"w{int(rng.paretovariate(0.8)) % 5000}" for _ in range(n)]


@pytest.fixture(scope="module")
def lists(spark):
    rows = [(i, zipf(40, i)) for i in range(1500)]
    rows += [(2000, None), (2001, []), (2002, [None, "w1", None])] + [(3000 + i, ["hot"] * 50) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id int, words array<string>").repartition(6).cache()


def counted(rows, k):
    counts = Counter(w for _, words in rows for w in words or () if w is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("capacity, k, limit", [(10**6, 25, 100), (300, 10, 10**5), (300, 10, 1), (5, 50, 10**5), (300, 10**5, 10**5)])
def test_equals_plain_counts(lists, capacity, k, limit):
    rows, df = lists
    got = [tuple(r) for r in heavy.top_k(df, "words", k, capacity, limit).collect()]
    assert got == counted(rows, k)


def test_bounds_hold(lists):
    rows, df = lists
    got = heavy.summaries(df, "words", 100).groupBy("value").agg(F.sum("n").alias("n")).collect()
    found = {r.value: r.n for r in got}
    error = found.pop(None)
    truth = dict(counted(rows, 10**6))
    assert error > 0 and len(found) <= 6 * 100
    assert all(found.get(w, 0) <= n <= found.get(w, 0) + error for w, n in truth.items())


def test_summary_keeps_what_is_frequent():
    summary = heavy.Summary(3)
    for i in range(200):
        summary.add(pa.array(["a", "b", f"rare{i}", f"other{i}"]))
    summary.shrink()
    assert {"a", "b"} <= set(summary.counts) and summary.counts["a"] + summary.error >= 200


def test_no_rows(lists):
    _, df = lists
    assert heavy.top_k(df.limit(0), "words", 5).count() == 0
    assert heavy.top_k(df.filter("id = 2000"), "words", 5).count() == 0

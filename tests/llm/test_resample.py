"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postloom.llm import resample

from .conftest import prose


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs_of(text, runs):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def judged(rows, target, runs=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in rows for f in runs_of(t, runs))
    t = Counter(place(f) for text in target for f in runs_of(text, runs))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for at, (i, text) in enumerate(rows):
        found = runs_of(text, runs)
        weight = sum(gain(place(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words_of(text)), at])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0], r[6]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, " ".join(prose(31, 400))), (2, None), (3, "One TWO three x1")], "item_id bigint, text string")


@pytest.mark.parametrize("sorted_rows", [1, 10**5])
@pytest.mark.parametrize("runs", [1, 3])
def test_draws(spark, corpus, target, runs, sorted_rows):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    rows += [(100 + i, " ".join(prose(200 + i, rng.randrange(1, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    options = {"runs": runs, "percent": 30, "min_words": 8}
    got = resample.draw(docs, target, columns=["doc_id"], sorted_rows=sorted_rows, **options).collect()
    want = judged(rows, [r.text for r in target.collect()], **options)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == want
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(r.rank is not None for r in got) + 1))


def test_ties_and_repeats(spark, target):
    """A third of the rows have no id and one text: equal scores, and as many ranks as wanted."""
    same = " ".join(prose(40, 30))
    rows = [(None, same)] * 100 + [(7, same)] * 50 + [(i, " ".join(prose(i, 25))) for i in range(1000, 1150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for percent in (0, 7, 40, 100):
        got = resample.draw(docs, target, columns=["doc_id"], percent=percent, sorted_rows=3).collect()
        ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
        assert [r.rank for r in ranked] == list(range(1, 3 * percent + 1))
        keys = [(-r.score, 2**63 if r.doc_id is None else r.doc_id) for r in got]
        assert [(-r.score, 2**63 if r.doc_id is None else r.doc_id) for r in ranked] == sorted(keys)[: 3 * percent]


def test_columns_and_empty_tables(spark, corpus, nothing, target):
    docs = corpus.withColumns({"score": F.lit("mine"), "rank": F.lit(1), "Row": F.lit(2), "id": F.lit(3)})
    drawn = resample.resample(docs, target, percent=50)
    assert drawn.columns == docs.columns and 0 < drawn.count() < docs.count()
    assert {r.score for r in drawn.collect()} == {"mine"}
    assert resample.report(nothing, target).count() == 0
    got = resample.report(docs, target.limit(0)).collect()
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert Counter(tuple(r) for r in got) == judged(rows, [])


def test_long_texts(monkeypatch):
    monkeypatch.setattr(resample, "SLICE_BYTES", 50)
    text = " ".join(prose(50, 300)) + " É日本 xX"
    for runs in (1, 2, 3):
        got = Counter()
        words = 0
        for n, found in resample.features(text.encode(), runs, 1000):
            got.update(found.tolist())
            words += n
        assert words == len(words_of(text))
        assert got == Counter(zlib.crc32(f.encode()) % 1000 for f in runs_of(text, runs))


@pytest.mark.parametrize("heavy", [0, 50, 900])
def test_locates_any_rank(spark, heavy):
    rng = random.Random(9)
    values = [5] * heavy + [-3] * (heavy // 2) + [rng.randrange(-1000, 1000) for _ in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "x bigint").repartition(4)
    values.sort()
    for wanted in (1, 2, len(values) // 2, heavy + 3, len(values)):
        want = values[wanted - 1]
        assert resample.locate(rows, "x", wanted, len(values), 4) == (want, sum(v < want for v in values))

"""Near, word-window and byte-string duplicates against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postloom.llm import near_dedup, substring_dedup, suffix_dedup
from postloom.llm.components import components
from postloom.llm.suffix_array import permuted_prefixes, suffix_array

from .conftest import prose

LAST = 2**63


def rows_of(corpus):
    return [(r.doc_id, r.text or "") for r in corpus.collect()]


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    words = [w for w in words if w]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


@pytest.mark.parametrize("small", [0, 8])
def test_near_groups(corpus, small):
    rows = [(i, shingles(t)) for i, t in rows_of(corpus)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and 100 * len(x & y) >= 85 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: LAST)
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least[g], LAST if i is None else i)
    want = Counter((i, len(s), None if least[g] == LAST else least[g]) for g, (i, s) in zip(group, rows, strict=True))
    got = near_dedup.link(corpus.withColumn("id", F.lit(1)).withColumn("kept", F.lit(0)), small=small).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("known", [0, 10**6])
def test_one_of_each_group_stays(corpus, monkeypatch, known):
    monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", known)
    kept = near_dedup.keep_one(corpus)
    assert kept.columns == corpus.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 0 in ids and 1 not in ids and 2 not in ids and 9 not in ids and ids[3] == 1


def test_rows_without_an_id_of_their_own(spark):
    texts = [prose(20 + k, 60) for k in range(6)]
    near = lambda k: " ".join([*texts[k][:-1], "edited"])
    whole = [" ".join(t) for t in texts]
    rows = [(3, whole[0]), (7, whole[1]), (None, near(0)), (None, near(1)), (None, whole[2]), (None, whole[3]), (None, near(3))]
    rows += [(9, whole[4]), (9, whole[5]), (8, near(5)), (None, None), (None, ""), (None, whole[2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id) for r in near_dedup.link(docs, small=0).collect())
    assert got == Counter([(3, 3), (7, 7), (None, 3), (None, 7), (9, 9), (9, 8), (8, 8)] + [(None, None)] * 6)
    kept = Counter((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect())
    either = [(None, t) for t in (whole[3], near(3)) if (None, t) in kept]
    assert len(either) == 1
    assert kept == Counter(either + [(3, whole[0]), (7, whole[1]), (None, whole[2]), (9, whole[4]), (8, near(5)), (None, None), (None, "")])


def test_hot_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = base.copy()
        words[3 * i % 190 + 2] = f"edit{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.filter("component_id = 0").count() == 60


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def windows_judged(rows, size):
    first = {}
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - size + 1):
            key = tuple(words[k : k + size])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = Counter()
    for i, text in rows:
        words = text.split()
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (LAST if i is None else i):
                gone |= set(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bucket_words", [50, 10**6])
def test_repeated_windows(corpus, bucket_words):
    got = substring_dedup.remove_repeats(corpus.withColumn("part", F.lit("x")), bucket_words=bucket_words)
    got = got.withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == windows_judged(rows_of(corpus), 13)


def rows_without_ids(spark):
    """Null and repeated ids: equal texts, texts of their own, and passages that other documents have."""
    passage = prose(60, 100)
    rows = [(4, " ".join(passage)), (9, " ".join(prose(61, 90))), (9, " ".join(prose(62, 50) + passage[20:80])), (9, " ".join(prose(61, 90)))]
    rows += [(None, " ".join(prose(70 + i, 80))) for i in range(6)] + [(None, " ".join(passage[10:70] + prose(63, 30)))] * 3
    rows += [(None, None), (None, ""), (None, " ".join(prose(61, 90)))]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("known", [0, 10**6])
def test_rows_that_share_an_id(spark, monkeypatch, known):
    rows, docs = rows_without_ids(spark)
    rows = [(i, t or "") for i, t in rows]
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", known)
    got = substring_dedup.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == windows_judged(rows, 13)
    got = suffix_dedup.remove_repeats(docs, length=100, anchor=40).withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got) == bytes_judged(rows, 100)


def test_equal_short_hashes_do_not_mix_rows(spark):
    """Two texts without ids whose first hashes agree in 32 bits: a copy of one leaves the other alone."""
    texts = spark.range(120_000).select(F.concat(F.lit("n"), "id").alias("t"), F.xxhash64(F.concat(F.lit("n"), "id")).alias("h"))
    low = F.col("h").bitwiseAND(F.lit(2**32 - 1))
    pair = texts.groupBy(low.alias("low")).agg(F.collect_list("t").alias("t")).filter("size(t) > 1").first().t[:2]
    # One word is too short for a window, so the collision is forced in the key itself.
    rows = spark.createDataFrame([(None, t) for t in pair], "doc_id bigint, text string")
    keys = {tuple(r) for r in substring_dedup.keyed(rows, "doc_id", "text").select(*substring_dedup.ROW).collect()}
    assert len(keys) == 2 and len({k[1] & (2**32 - 1) for k in keys}) == 1


def test_marks_of_a_hot_passage_spread(spark):
    """A passage of every document: its copies' marks are dealt by document, not to its bucket."""
    passage = " ".join(prose(80, 60))
    docs = spark.createDataFrame([(i, f"{passage} {' '.join(prose(500 + i, 20))}") for i in range(400)], "doc_id bigint, text string")
    rows = substring_dedup.keyed(docs, "doc_id", "text").coalesce(1)
    levels, _ = substring_dedup.count_levels(rows, "text", substring_dedup._items(2))
    packed = substring_dedup._super_kmers(rows, levels, 40, 13, 2).groupBy("bucket").agg(F.sum("n").alias("n"))
    sizes = sorted(r.n for r in packed.collect())
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
    got = substring_dedup.remove_repeats(docs, bucket_words=800).filter("doc_id > 0").select("n_removed").distinct().collect()
    assert min(r.n_removed for r in got) >= 60


def bytes_judged(rows, length):
    seen = Counter()
    for _, text in rows:
        data = text.encode()
        seen.update(data[k : k + length] for k in range(len(data) - length + 1))
    out = Counter()
    for i, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shard_bytes", [2000, 10**6])
def test_repeated_bytes(corpus, shard_bytes):
    rows = corpus.withColumn("start", F.lit(5)).withColumn("marks", F.lit(1))
    got = suffix_dedup.remove_repeats(rows, shard_bytes=shard_bytes).withColumn("sha", F.sha2("kept", 256)).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got)
    assert found == bytes_judged(rows_of(corpus), suffix_dedup.LENGTH)


def test_empty_tables(nothing):
    assert near_dedup.link(nothing).count() == 0
    assert substring_dedup.report(nothing).count() == 0
    assert suffix_dedup.report(nothing).count() == 0


def test_larger_rarity_tables(corpus, monkeypatch):
    from postloom.llm import minimizers

    monkeypatch.setattr(minimizers, "LEVEL_BYTES", 1000)
    got = substring_dedup.remove_repeats(corpus, bucket_words=200).withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == windows_judged(rows_of(corpus), 13)


def test_suffix_arrays():
    import numpy as np

    rng = np.random.default_rng(4)
    for trial in range(150):
        text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 60)).astype(np.uint8)
        text = np.tile(text, 1 + trial % 3)
        data = text.tobytes()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        before, prefix = permuted_prefixes(text, order, 9)
        for i in range(len(data)):
            j = before[i]
            common = 0
            while j >= 0 and common < 9 and data[i + common : i + common + 1] == data[j + common : j + common + 1] != b"":
                common += 1
            assert prefix[i] == common


def test_suffix_array_goes_by_bytes_not_words(spark):
    """Passages of over 50 words go if they have 400 bytes; shorter ones and documents without any stay."""
    long, short = " ".join(f"longword{i:03d}" for i in range(60)), " ".join(f"w{i:02d}" for i in range(60))
    assert len(long) > suffix_dedup.LENGTH > len(short)
    texts = [f"{i:04d} " + " ".join(prose(300 + i, 80)) for i in range(6)]
    texts = [texts[0] + "<" + long, texts[1] + ">" + long, texts[2] + "<" + short, texts[3] + ">" + short, *texts[4:]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.report(rows).collect()}
    assert [got[i].n_removed for i in range(6)] == [len(long), len(long), 0, 0, 0, 0]
    assert [got[i].n_bytes for i in range(6)] == [len(t.encode()) for t in texts]

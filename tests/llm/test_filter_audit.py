"""Filter interactions against a loop over all orders and documents."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postloom.llm import filter_audit

from .conftest import prose

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def judged(rows, labels):
    """``rows`` are (id, text, part); ``labels`` (id, quality, toxic)."""
    least, parts = {}, {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (text in least and (i is None or least[text] < i))
        parts.setdefault(part or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                fails = sum(f in d[0] for d in docs)
                only = sum(d[0] == f for d in docs)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), only, sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def mixed_rows():
    rng, rows = random.Random(2), []
    for i in range(300):
        words = prose(rng.randrange(40), rng.choice([20, 99, 100, 130]))
        if rng.random() < 0.3:
            words = words[: len(words) // 2] * 2
        text = " ".join(words)
        text = text.upper() if rng.random() < 0.2 else text
        text += rng.choice(["", "", " #", " é|ñ"])
        rows.append((None if rng.random() < 0.1 else rng.randrange(250), text, rng.choice(["en", "fr", None, ""])))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, None, "zz"), (1002, " \t", "zz"), (None, "only here", None), (None, "only here", "zz")]
    rows += [(5000 + i, "hot " * 120, "en") for i in range(200)] + [(None, "hot " * 120, "fr")] * 30
    return rows


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_equals_a_loop(spark):
    rows = mixed_rows()
    rng = random.Random(4)
    labels = [(rng.randrange(260), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)]
    labels += [(None, 1, 1), (5001, 1, 0), (5002, 0, 1), (5000, 1, 1), (10**6, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    clashing = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "n", "id", "good", "rank")})
    got = filter_audit.report(clashing, marks.withColumn("n", F.lit(7)))
    want = judged(rows, labels)
    assert got.count() == len(want) == 600 * len({p or "" for _, _, p in rows})
    assert found(got) == want
    assert found(filter_audit.report(docs, marks.limit(0))) == judged(rows, [])
    assert filter_audit.report(docs.limit(0), marks).count() == 0


def test_long_text(spark):
    rows = [(1, "Aa bb " * 400_000, "en"), (2, " ".join(map(str, range(200_000))), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = [(1, 1, 1)]
    assert found(filter_audit.report(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))) == judged(rows, labels)


def test_swaps_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in filter_audit.adjacent_swaps(n):
            order[at : at + 2] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == [0, 1, 2, 6, 24, 120, 720][n]


@pytest.mark.parametrize("seed", range(5))
def test_swapped_diagrams_hold_the_same_counts(seed):
    rng = random.Random(seed)
    weights = {m: (rng.randrange(3), rng.randrange(2), 1) for m in rng.sample(range(32), rng.randrange(1, 33))}
    diagram = filter_audit.Diagram(weights, range(5))
    for at in filter_audit.adjacent_swaps(5):
        diagram.swap(at)
        built = filter_audit.Diagram(weights, diagram.order)

        def leaves(d, node, mask=0):
            name, a, b = d.nodes[node]
            if name is None:
                return {mask: a} if any(a) else {}
            return leaves(d, a, mask) | leaves(d, b, mask | 1 << name)

        assert leaves(diagram, diagram.root) == leaves(built, built.root) == weights
        assert diagram.all_pass() == built.all_pass()
        # As many nodes can be reached as in a diagram built in this order: nothing is kept twice.
        reach = lambda d, n: {n}.union(*(reach(d, x) for x in d.nodes[n][1:] if d.nodes[n][0] is not None))
        assert len(reach(diagram, diagram.root)) == len(reach(built, built.root))

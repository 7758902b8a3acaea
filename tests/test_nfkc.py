"""NFKC by tables against ``unicodedata``."""

import random
import sys
import unicodedata

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postloom.functions import nfkc as N


def normal(text):
    return None if text is None else unicodedata.normalize("NFKC", text)


def different(spark, texts):
    rows = spark.createDataFrame([(t, normal(t)) for t in texts], "t string, want string").repartition(8)
    return [(r.t, r.got, r.want) for r in rows.withColumn("got", N.nfkc(F.col("t"))).filter("NOT got <=> want").take(5)]


def test_every_character(spark):
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    assert max(c for c in codes if normal(chr(c)) != chr(c)) <= N._LAST_FORM
    plain = [c for c in codes if normal(chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c % 16]
    chosen = sorted(set(codes) - set(plain))  # all that change or combine, and one of 16 others
    assert not different(spark, [f"e{chr(c)}x" for c in chosen])
    assert not different(spark, [chr(c) for c in chosen if normal(chr(c)) != chr(c)])


def test_every_composed_pair(spark):
    pairs = list(N.tables().pairs)
    assert not different(spark, [f"a{p}b" for p in pairs] + [f"{p}{q}" for p, q in zip(pairs, pairs[1:], strict=False)])


def test_random_sequences(spark):
    rng = random.Random(11)
    t = N.tables()
    marks = [chr(c) for c in range(sys.maxunicode) if unicodedata.combining(chr(c))]
    jamo = [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC40))]
    pools = [marks, jamo, list(t.singles), list(t.expansions), list(t.pairs), sorted(t.left), list("aeiou AEIOU.")]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 8))) for _ in range(6000)]
    assert not different(spark, texts)
    assert not different(spark, [None, "", "\0", "ﬁ" * 40000, "é" * 40000, "́" * 1000])


@pytest.mark.parametrize("text", ["ﬁn ½ m² ％ ｆｕｌｌ", "café Å", "が", "①…™ ㎏", "❤️ ﷲ"])
def test_tables_suffice(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(N.left_to_python(N.composed(F.col("t"))).alias("left"), N.nfkc(F.col("t")).alias("got")).first()
    assert not row.left
    assert row.got == normal(text)


def test_python_gets_the_rest(spark):
    df = spark.createDataFrame([("ẹ́",), ("가",), ("ﷺ",)], "t string")
    assert all(r[0] for r in df.select(N.left_to_python(N.composed(F.col("t")))).collect())


def test_character_classes_turn_others_away_early(spark):
    chars = N.tables().expansions
    pattern = N.char_class(chars)
    assert pattern.count("&&") > 50  # halved, not one list of hundreds of ranges
    every = "".join(chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    got = spark.createDataFrame([(every,)], "t string").select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).first()[0]
    assert set(got) == set(chars)


def test_texts_of_emoji_flags_and_joiners_are_left_alone(spark):
    # F13 (lb1_lexicon_hits): these went the long way, though none of their characters has another form.
    plain = "\U0001F468\u200d\U0001F469 \U0001F1EA\U0001F1F8 \u00abe\u00bb \U0001F4AA\U0001F3FD \u2764\ufe0f"
    others = ["\ufb01n", "e\u0301", "\u1100\u1161", "a\u00a0b"]
    df = spark.createDataFrame([(plain, False), *((t, True) for t in others)], "t string, want boolean")
    assert normal(plain) == plain
    assert not df.filter(N.may_change(F.col("t")) != F.col("want")).count()


def test_functions_can_be_sent_after_use(spark):
    import postloom
    from postloom.operators import features as FE

    assert not different(spark, ["ẹ́"])

    def load():
        return FE.trigram_model(8)

    known = "postloom" in cloudpickle.list_registry_pickle_by_value()
    cloudpickle.register_pickle_by_value(postloom)
    try:
        assert cloudpickle.dumps(load)
    finally:
        if not known:
            cloudpickle.unregister_pickle_by_value(postloom)

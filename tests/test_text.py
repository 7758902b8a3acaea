import re
import sys
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.config import PreprocessConfig
from postloom.functions import emoji as EM
from postloom.functions import patterns as P
from postloom.functions import text as X
from postloom.operators import text as TX


def clean(spark, texts, **config):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, full_text string")
    rows = TX.with_clean_text(df, PreprocessConfig(**config)).orderBy("id").collect()
    return [r["clean_text"] for r in rows]


GOLDEN = [
    ("Hola HTTP://x.y/z?q ñ @ana_ñ: #Canción-México bien-dicho a-b-c",
     "hola ñ : canción méxico bien dicho a b-c"),
    ("awwww www www.x wow", "a www wow"),
    ("Costa Rica y San José-centro", "costa_rica y san_josé centro"),
    ("mail a.b@host5.com ##dos", "mail a.b.com #dos"),
    ("🔥hola", "popularhola"),
    ("😂😂", "feliz feliz"),
    ("💪🏽 vamos", "vamos"),
    (None, "none"),
    ("ﬁn ①", "fin 1"),
    ("❤️ y ❤", "amor y"),
    ("⭐️ gol", "sobresaliente gol"),
    ("x👨‍👩‍👧y 🇪🇸 1️⃣", "x y"),
    ("a\u00a0b\x0bc\x85d", "a b c d"),
    ("#Mundial", "mundial"),
    ("🔥\ufe0e🔥 a\ufe0eb 👍\ufe0e🏽", "popular popular ab"),
    ("gol\n🔥\n", "gol popular"),
]


def test_golden(spark):
    assert clean(spark, [g[0] for g in GOLDEN]) == [g[1] for g in GOLDEN]


def test_modes(spark):
    texts = ["#gol ya 😂!", "a❤️b"]
    assert clean(spark, texts, hashtag_strategy="remove", emoji_strategy="remove") == ["ya !", "ab"]
    assert clean(spark, [None], null_text="keep") == [None]
    with pytest.raises(ValueError):
        PreprocessConfig(emoji_strategy="other")


def test_every_emoji_word(spark):
    words = list(EM.EMOJI_WORDS.items())
    assert clean(spark, [f"x{e}" for e, _ in words]) == [f"x {w}" for _, w in words]


def test_emoji_points_follow_unicode():
    ours = set()
    for span in EM.EMOJI_POINTS.split():
        low, _, high = span.partition("-")
        ours |= set(range(int(low, 16), int(high or low, 16) + 1))
    letters = set(range(0x1F1E6, 0x1F200))
    theirs = {c for c in range(0x80, 0x20000) if regex.match(r"\p{Emoji}", chr(c))} - letters
    assert ours == theirs


def stable_characters():
    pattern = "[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}",
                           X.NFKC_STABLE.replace("[", "").replace("]", "")) + "]"
    return [chr(c) for c in range(sys.maxunicode) if re.match(pattern, chr(c))]


def test_characters_skipped_by_nfkc_are_stable():
    chars = stable_characters()
    assert len(chars) > 20000
    moved = [c for c in chars if unicodedata.normalize("NFKC", c) != c]
    assert not moved
    assert not [c for c in chars if unicodedata.combining(c)]
    # No character composes with one before it: second halves of compositions are not in the set.
    seconds = set()
    for c in map(chr, range(sys.maxunicode)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    assert not seconds & set(chars)


def python_clean(text):
    """The chain in Python's own regex, without emoji."""
    low = unicodedata.normalize("NFKC", text).lower()
    low = re.sub(r"@\w+", "", re.sub(r"http\S+|www\S+", "", low))
    low = re.sub(r"#(\w+)", r"\1", low)
    for name in ("costa rica", "san josé"):
        low = low.replace(name, name.replace(" ", "_"))
    return re.sub(r"\s+", " ", re.sub(r"(\w)-(\w)", r"\1 \2", low)).strip()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("aéÑ 0_-#@\t\u00a0\u0301ﬁwWhtp./:x", max_size=30), min_size=200, max_size=200))
def test_cleaning_equals_python(spark, texts):
    assert clean(spark, texts) == [python_clean(t) for t in texts]


def column(spark, text, function):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(function(F.col("t")).alias("r")).first()["r"]


def test_tokens_and_hashtags(spark):
    assert column(spark, "l'eau, no! d_2 ''x", X.tokens) == ["l'eau", "no", "d_2", "x"]
    assert column(spark, "#gol❤️x #año_2", X.extract_hashtags) == ["#gol", "#año_2"]
    assert column(spark, "A bc D1", X.terms) == ["bc", "d1"]


def test_media_and_display(spark):
    df = spark.createDataFrame(
        [("x PIC.twitter.com",), ("pic.twitter.com/1 VIDEO",), ("YouTube",), (None,)], "full_text string"
    )
    assert tuple(TX.media_counts(df).first()) == (1, 2)
    assert column(spark, "a" * 221, X.truncate_text) == "a" * 220 + "..."
    assert column(spark, "a" * 220, X.truncate_text) == "a" * 220
    assert column(spark, "a" * 600, lambda c: X.cap_text(c, 512)) == "a" * 512
    assert column(spark, "a" * 600, X.cap_text) == "a" * 600


@pytest.mark.parametrize("options", [{}, {"row_bytes": 0}, {"row_bytes": 0, "max_bytes": 0}])
def test_lemmas(spark, options):
    df = spark.createDataFrame(
        [(1, ["los", "goles", "los"]), (2, []), (3, None), (4, ["x", "ya"])], "id int, tokens array<string>"
    )
    table = spark.createDataFrame([("los", "el"), ("goles", "gol"), ("ya", None)], "form string, lemma string")
    rows = {r["id"]: r["tokens"] for r in TX.with_lemmas(df, table, **options).collect()}
    assert rows == {1: ["el", "gol", "el"], 2: [], 3: None, 4: ["x", "ya"]}


@pytest.mark.parametrize("options", [{}, {"row_bytes": 0}, {"row_bytes": 0, "max_bytes": 0}])
def test_lemmas_of_rows_that_share_a_key(spark, options):
    rows = [("h", ["gatos", "x"]), ("h", ["perros"]), (None, ["gatos"]), (None, ["gatos"])]
    df = spark.createDataFrame(rows, "k string, tokens array<string>")
    table = spark.createDataFrame(
        [("gatos", "gato"), ("gatos", "felino"), ("perros", "perro"), (None, "y")], "form string, lemma string"
    )
    found = sorted(r["tokens"] for r in TX.with_lemmas(df, table, **options).collect())
    assert found == [["felino"], ["felino"], ["felino", "x"], ["perro"]]


def test_word_class_equals_python(spark):
    odd = "a1_éñ\u0301\ufe0f½²Ⅷ٣漢"
    found = column(spark, odd, lambda c: F.regexp_extract_all(c, F.lit(P.WORD), F.lit(0)))
    assert found == re.findall(r"\w", odd)


PIECES = st.lists(st.sampled_from([*"ahtpw-_'é7 \t\n\x1c\x85\xa0", "http", "www", "𝒜", "　", "  ", "-b-", "costa rica", " "]), max_size=25)


@settings(max_examples=30, deadline=None)
@given(st.lists(PIECES.map("".join), min_size=20, max_size=40))
def test_fast_patterns_match_as_the_plain_ones(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    t = F.col("t")
    pairs = [
        (X.strip_urls(t), F.regexp_replace(t, P.URL, "")),
        (X.split_hyphens(t), F.regexp_replace(t, P.HYPHENATED, "$1 $2")),
        (X.squeeze(t), F.trim(F.regexp_replace(t, P.SPACES, " "))),
        (X.join_compounds(t), F.replace(t, F.lit("costa rica"), F.lit("costa_rica"))),
    ]
    for got, want in pairs:
        assert [tuple(r) for r in df.filter(~got.eqNullSafe(want)).select(t, got, want).collect()] == []


def test_single_blanks_are_not_replaced(spark):
    # F14, F16 (fe2): each blank between two words was replaced by itself.
    row = spark.range(1).select(F.regexp_count(F.lit("a b c  d \te\nf"), F.lit(X._SPACES))).first()
    assert row[0] == 3


def test_hyphens_between_letters_of_two_units(spark):
    # Found by the test of the fast patterns: a letter beyond U+FFFF before the hyphen was not seen.
    assert column(spark, "𝒜-b-", X.split_hyphens) == "𝒜 b-"
    assert column(spark, "𝒜-𝒜-𝒜 😀-a", X.split_hyphens) == "𝒜 𝒜-𝒜 😀-a"

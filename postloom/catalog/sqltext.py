"""SQL text of the cleaning steps, for the comparison engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMPOUND_NAMES
from ..functions import patterns as P
from ..functions.emoji import EMOJI_FLAT, EMOJI_WORDS, VARIATION

# The supplied texts hold no links, tags or emoji; common words are replaced to bring them in.
NOISE = (
    (" the ", " HTTPS://t.co/Ab1?q=ñ "),
    (" is ", " seewww.x.es/q "),
    (" and ", " @Ana_ñ: "),
    (" of ", " #Gol2022 "),
    (" to ", " 🔥"),
    (" de ", " #Canción-México "),
    (" la ", " 😂😂 "),
    (" que ", " ❤️ vs ❤ "),
    (" der ", " 💪🏽 y 💪 "),
    (" die ", " 🐸️ ##dos "),
    (" und ", " Costa Rica"),
    (" en ", " pic.twitter.com/x "),
    (" les ", " YouTube 👨‍👩‍👧 🇪🇸 "),
    (" et ", " bien-dicho a-b-c\t\n"),
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def noisy(text: Column) -> Column:
    for old, new in NOISE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def noisy_sql(text: str) -> str:
    for old, new in NOISE:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return text


def regex_sql(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {quote(pattern)}, {quote(new)}, 'g')"


def urls_sql(text: str) -> str:
    return regex_sql(text, P.URL, "")


def mentions_sql(text: str) -> str:
    return regex_sql(text, P.MENTION, "")


def hashtags_sql(text: str, mode: str = "normalize") -> str:
    if mode == "normalize":
        return regex_sql(text, P.HASHTAG_BODY, r"\1")
    return regex_sql(text, P.HASHTAG, "")


def emoji_removed_sql(text: str) -> str:
    return regex_sql(regex_sql(text, EMOJI_FLAT, ""), VARIATION, "")


def emoji_mapped_sql(text: str) -> str:
    pairs = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in EMOJI_WORDS.items())
    words = f"MAP {{{pairs}}}"
    found = f"regexp_extract_all({text}, {quote(EMOJI_FLAT)})"
    pieces = f"string_split_regex({text}, {quote(EMOJI_FLAT)})"
    bare = regex_sql("p[2]", VARIATION, "")
    word = f"coalesce({words}[p[2]], {words}[{bare}], '')"
    glued = f"CASE WHEN p[2] IS NULL THEN p[1] ELSE p[1] || ' ' || {word} END"
    mapped = (
        f"array_to_string(list_transform(list_zip({pieces}, {found}), lambda p: {glued}), '')"
    )
    return regex_sql(mapped, VARIATION, "")


def compounds_sql(text: str) -> str:
    for name in COMPOUND_NAMES:
        low = name.lower()
        text = f"replace({text}, {quote(low)}, {quote(low.replace(' ', '_'))})"
    return text


def hyphens_sql(text: str) -> str:
    return regex_sql(text, P.HYPHENATED, r"\1 \2")


def squeeze_sql(text: str) -> str:
    return f"trim({regex_sql(text, P.SPACES, ' ')})"


def cleaned_cte(source: str, text: str, name: str = "cleaned", mode: str = "map") -> str:
    """CTEs that add ``clean_text`` to the rows of ``source``."""
    emoji = emoji_mapped_sql("t1") if mode == "map" else emoji_removed_sql("t1")
    first = hashtags_sql(mentions_sql(urls_sql(f"lower(coalesce({text}, 'None'))")))
    last = squeeze_sql(hyphens_sql(compounds_sql("t2")))
    return f"""{name}_1 AS (SELECT *, {first} AS t1 FROM {source}),
{name}_2 AS (SELECT *, {emoji} AS t2 FROM {name}_1),
{name} AS (SELECT * EXCLUDE (t1, t2), {last} AS clean_text FROM {name}_2)"""


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {quote(P.TOKEN)})"


def terms_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {quote(P.TERM)})"

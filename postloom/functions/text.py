"""String functions of the cleaning step, each one Column in, Column out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMPOUND_NAMES
from . import patterns as P
from .emoji import EMOJI_WORDS, map_emoji, remove_emoji
from .nfkc import NFKC_STABLE, nfkc  # noqa: F401

# Java forms of the patterns in ``patterns``, with the same matches. Most characters fail the first test
# of a pattern, so each begins with one that turns them away.
_URL = f"[hw](?:(?<=h)ttp|(?<=w)ww){P.NOT_SPACE}+"
# A hyphen behind the word character of the match before is none: that character is used up. Java looks behind by
# code points, not by halves of surrogate pairs, if the pattern holds such a character itself; U+10000 is a letter.
_HYPHEN = f"-(?<=[{P.WORD}\U00010000]-)({P.WORD})(-?)"
_SPACE = (
    r"[\x09-\x20\x{85}-\x{3000}&&[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
)
# Runs of white space that are not one blank already.
_SPACES = rf"{_SPACE}(?:{_SPACE}++|(?<! ))"


def strip_urls(text: Column) -> Column:
    """Delete from ``http`` or ``www`` to the next blank, also inside a word."""
    return F.regexp_replace(text, _URL, "")


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, P.MENTION, "")


def hashtags(text: Column, mode: str = "normalize") -> Column:
    """``normalize`` keeps the word of ``#word``, ``remove`` deletes both."""
    if mode == "normalize":
        return F.regexp_replace(text, P.HASHTAG_BODY, "$1")
    if mode == "remove":
        return F.regexp_replace(text, P.HASHTAG, "")
    raise ValueError(f"unknown hashtag mode {mode!r}")


def emojis(text: Column, mode: str = "map", words: Mapping[str, str] = EMOJI_WORDS) -> Column:
    if mode == "map":
        return map_emoji(text, words)
    if mode == "remove":
        return remove_emoji(text)
    raise ValueError(f"unknown emoji mode {mode!r}")


def join_compounds(text: Column, names: Iterable[str] = COMPOUND_NAMES) -> Column:
    """Glue the words of known names with an underscore; expects lower-case text.

    One scan for what follows a name's first blank passes over texts without any name.
    """
    lows = [name.lower() for name in names if " " in name]
    if not lows:
        return text
    glued = text
    for low in lows:
        glued = F.replace(glued, F.lit(low), F.lit(low.replace(" ", "_")))
    ends = "|".join(re.escape(low[low.index(" ") + 1 :]) for low in lows)
    return F.when(text.rlike(f" (?:{ends})"), glued).otherwise(text)


def split_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, _HYPHEN, " $1$2")


def squeeze(text: Column) -> Column:
    """Turn each run of white space into one blank and strip both ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def tokens(text: Column) -> Column:
    """Words without punctuation; an apostrophe between letters stays inside the word."""
    return F.regexp_extract_all(text, F.lit(P.TOKEN), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-case runs of two or more word characters, as counted by the features."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.TERM), F.lit(0))


def extract_hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.HASHTAG), F.lit(0))


def has_image(text: Column) -> Column:
    return text.contains("pic.twitter.com")


def has_video(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("video") | low.contains("youtu")


def truncate_text(text: Column, limit: int = 220) -> Column:
    """For display: a text longer than ``limit`` is cut and ends in ``...``."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def cap_text(text: Column, limit: int | None = None) -> Column:
    """For model inputs with a hard size limit; without a limit the whole text is passed."""
    return text if limit is None else F.substring(text, 1, limit)

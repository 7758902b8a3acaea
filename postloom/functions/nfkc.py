"""Unicode NFKC as a column expression, over tables derived from ``unicodedata``.

A text falls into clusters: a character, and the characters after it that may attach to it (marks,
and whatever composes with a predecessor). Clusters are normalised independently of each other. A
cluster of one character is looked up: a character becomes one other or up to ``LONGEST`` others.
A cluster of a letter and one mark that have a precomposed form becomes that form. Texts with any
other cluster (several marks, conjoining jamo, characters newer than the JVM's Unicode) and the few
longer expansions are left to ``unicodedata`` in Arrow batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that NFKC leaves alone in any order: ASCII, most Latin letters, Cyrillic, kana,
# common CJK, plain punctuation and pictographs. A text made of these stays as it is.
NFKC_STABLE = (
    r"\x{0}-\x{7F}"
    r"[\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}"
    r"\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}"
    r"\x{1CD}-\x{1F0}\x{1F4}-\x{2AF}\x{400}-\x{482}\x{48A}-\x{52F}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{20A0}-\x{20A7}\x{20A9}-\x{20C0}"
    r"\x{2600}-\x{27BF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}"
    r"\x{FE0F}\x{FFFD}\x{1F300}-\x{1FAFF}]"
)
LONGEST = 4
_LAST_FORM = 0x2FFFF  # no character above it has another form
_JAMO = (range(0x1161, 0x1176), range(0x11A8, 0x11C3))  # vowels and finals, composed by rule


class Tables(NamedTuple):
    """Single replacements, expansions by position, composed pairs, and characters left to Python."""

    singles: dict[str, str]
    expansions: dict[str, str]
    pairs: dict[str, str]
    left: set[str]


@cache
def tables() -> Tables:
    chars = [chr(c) for c in range(_LAST_FORM + 1) if not 0xD800 <= c < 0xE000]
    pairs = {}
    for c in chars:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFKC", pair) == c:
                pairs[pair] = c
    seconds = {p[1] for p in pairs} | {chr(c) for r in _JAMO for c in r}
    singles, expansions, left = {}, {}, set()
    for c in chars:
        first = unicodedata.normalize("NFKD", c)[0]
        if unicodedata.combining(first) or first in seconds:
            left.add(c)
            continue
        form = unicodedata.normalize("NFKC", c)
        if len(form) > LONGEST:
            left.add(c)
        elif len(form) > 1:
            expansions[c] = form
        elif form != c:
            singles[c] = form
    return Tables(singles, expansions, pairs, left)


def char_class(chars: Iterable[str]) -> str:
    """The characters as a class of a regular expression.

    A class is tested range by range, so long lists are halved again and again: a character outside
    is turned away after two comparisons, any other one after some ten.
    """
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])

    def spelled(part: list[list[int]]) -> str:
        if len(part) <= 4:
            return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in part)
        middle = len(part) // 2
        halves = part[:middle], part[middle:]
        return "".join(rf"[\x{{{h[0][0]:X}}}-\x{{{h[-1][1]:X}}}&&[{spelled(h)}]]" for h in halves)

    return f"[{spelled(spans)}]"


def _mapped(text: Column, table: dict[str, str]) -> Column:
    mapped = F.translate(text, "".join(table), "".join(table.values()))
    return F.when(text.rlike(char_class(table)), mapped).otherwise(text)


def composed(text: Column) -> Column:
    """A letter and the mark after it become their precomposed form, where there is one."""
    pairs = tables().pairs
    first, second = char_class({p[0] for p in pairs}), char_class({p[1] for p in pairs})
    words = F.map_from_arrays(
        F.split(F.lit(" ".join(pairs)), " "), F.split(F.lit(" ".join(pairs.values())), " ")
    )
    pieces = F.split(text, f"(?={first}{second})")  # a piece begins with its pair

    def form(piece: Column) -> Column:
        found = F.try_element_at(words, F.left(piece, F.lit(2)))
        return F.when(found.isNull(), piece).otherwise(F.concat(found, _after(piece, 2)))

    return F.when(text.rlike(second), F.array_join(F.transform(pieces, form), "")).otherwise(text)


def expanded(text: Column) -> Column:
    """Characters that stand for several, such as ligatures, fractions and units, are written out."""
    table = tables().expansions
    special = char_class(table)
    pieces = F.split(text, f"(?={special})")  # a piece begins with its special character

    def form(piece: Column) -> Column:
        char = F.left(piece, F.lit(1))
        spelled = [_at(char, table, i) for i in range(LONGEST)]
        return F.when(char.rlike(special), F.concat(*spelled, _after(piece, 1))).otherwise(piece)

    return F.when(text.rlike(special), F.array_join(F.transform(pieces, form), "")).otherwise(text)


def _after(text: Column, n: int) -> Column:
    return F.substring(text, n + 1, 2**31 - 1 - n)


def _at(char: Column, table: dict[str, str], i: int) -> Column:
    """Character ``i`` of the expansion; ``translate`` deletes what has no counterpart."""
    there = [c for c, form in table.items() if i < len(form)]
    gone = [c for c, form in table.items() if i >= len(form)]
    return F.translate(char, "".join(there + gone), "".join(table[c][i] for c in there))


def _by_unicodedata(text: Column) -> Column:
    """The function is made per call: once used, it holds its session and could not be sent with this module."""

    @F.pandas_udf(T.StringType())
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return normalized(text)


def may_change(text: Column) -> Column:
    """Whether a text holds a character with another form, or one that may attach to its predecessor."""
    return text.rlike(char_class([*tables().singles, *tables().expansions, *tables().left]))


def left_to_python(composed_text: Column) -> Column:
    """Whether a text, its pairs composed, still holds what the tables do not cover."""
    left = char_class(c for c in tables().left if not unicodedata.category(c).startswith("M"))
    stable = r"\x{FE0F}\x{1F300}-\x{1FAFF}"
    return composed_text.rlike(rf"[\x{{80}}-\x{{10FFFF}}&&[\p{{M}}\p{{Cn}}{left}]&&[^{stable}]]")


def nfkc(text: Column) -> Column:
    """Unicode NFKC of a text; null stays null."""
    changing = may_change(text)
    whole = composed(text)
    outside = left_to_python(whole)
    by_table = expanded(_mapped(whole, tables().singles))
    by_python = _by_unicodedata(F.when(changing & outside, text))
    return F.coalesce(by_python, F.when(changing, by_table), text)

"""Emoji sequences: the pattern that finds them and the word each one stands for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points with the Unicode property Emoji, without ASCII and regional letters.
EMOJI_POINTS = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA
24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620
2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666
2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1
26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD
2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E
2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50
2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A
1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397
1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567
1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8
1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3
1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0
1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C
1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
"""

# The word that replaces each emoji in mapping mode.
EMOJI_WORDS = {
    "🙂": "feliz",
    "😊": "feliz",
    "🤣": "feliz",
    "😂": "feliz",
    "😎": "feliz",
    "💀": "feliz",
    "😢": "triste",
    "😭": "triste",
    "😔": "triste",
    "🤬": "enojado",
    "😡": "enojado",
    "😠": "enojado",
    "😤": "enojado",
    "❤️": "amor",
    "🥰": "amor",
    "😍": "amor",
    "💕": "amor",
    "🥳": "celebracion",
    "🫠": "incomodo",
    "😅": "nervioso",
    "🙈": "verguenza",
    "😳": "verguenza",
    "🐸": "ironia",
    "💩": "apesta",
    "💅": "desinteresado",
    "🙃": "sarcasmo",
    "💪": "motivado",
    "👏": "reconocimiento",
    "🤔": "duda",
    "😜": "coqueto",
    "😏": "coqueto",
    "🤯": "sorprendido",
    "🥺": "suplica",
    "🤡": "ridiculo",
    "🔥": "popular",
    "⭐": "sobresaliente",
    "😐": "indiferencia",
    "😇": "inocente",
    "🤮": "apesta",
    "🥶": "impactado",
}


def _char_class(points: str) -> str:
    spans = ("-".join(rf"\x{{{p}}}" for p in span.split("-")) for span in points.split())
    return "".join(spans)


def _layered_class(points: str) -> str:
    """Java class that looks at the long list only for characters of the right block."""
    blocks: dict[str, list[str]] = {"A0-FF": [], "2000-3300": [], "1F000-1FAFF": []}
    for span in points.split():
        first = int(span.split("-")[0], 16)
        for block, spans in blocks.items():
            low, high = (int(x, 16) for x in block.split("-"))
            if low <= first <= high:
                spans.append(span)
    parts = (f"[{_char_class(b)}&&[{_char_class(' '.join(s))}]]" for b, s in blocks.items())
    return "[" + "".join(parts) + "]"


def sequence_pattern(base: str) -> str:
    """A flag, a keycap, or emoji units (with variation sign, skin tone or tags) joined by U+200D."""
    unit = rf"{base}[\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]?"
    tags = r"(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
    return (
        r"[\x{1F1E6}-\x{1F1FF}]{2}"
        r"|[0-9#*]\x{FE0F}?\x{20E3}"
        rf"|{unit}{tags}(?:\x{{200D}}{unit})*"
    )


EMOJI = sequence_pattern(_layered_class(EMOJI_POINTS))
# The same without class intersection, for regex engines that lack it.
EMOJI_FLAT = sequence_pattern(f"[{_char_class(EMOJI_POINTS)}]")
TEXT_SIGN, EMOJI_SIGN = "\ufe0e", "\ufe0f"
VARIATION = r"[\x{FE0E}\x{FE0F}]"
# Coarse superset of everything above: texts that miss it skip the exact pattern.
MAYBE_EMOJI = (
    r"[\x{A9}\x{AE}[\x{203C}-\x{1FAFF}&&"
    r"[\x{203C}-\x{3299}\x{FE0E}\x{FE0F}\x{1F000}-\x{1FAFF}]]]"
)

# Every sequence starts with one of these (and some others).
MAY_START = r"(?=[#-9\x{A9}\x{AE}\x{203C}-\x{1FAFF}])"


def remove_emoji(text: Column) -> Column:
    """Delete emoji sequences and stray variation signs."""
    bare = F.regexp_replace(text, f"{MAY_START}(?:{EMOJI}|{VARIATION})", "")
    return F.when(text.rlike(MAYBE_EMOJI), bare).otherwise(text)


def map_emoji(text: Column, words: Mapping[str, str] = EMOJI_WORDS) -> Column:
    """Put a blank and its word in place of each known emoji, a blank for the others.

    A sequence counts as known only as a whole, so a skin-toned variant of a known emoji
    becomes a blank. A variation sign after an emoji that does not need it is ignored.
    """
    lookup = F.create_map(*[F.lit(part) for pair in words.items() for part in pair])

    def word(found: Column) -> Column:
        return F.coalesce(
            F.try_element_at(lookup, found),
            F.try_element_at(lookup, F.regexp_replace(found, VARIATION, "")),
            F.lit(""),
        )

    def replaced(piece: Column) -> Column:
        is_emoji = piece.rlike(rf"\A(?:{EMOJI})\z")
        return F.when(is_emoji, F.concat(F.lit(" "), word(piece))).otherwise(piece)

    # Each emoji is cut out between two text-variation signs. That sign is never part of a
    # sequence and is dropped from the result anyway, so signs already in the text do no harm.
    # The lookahead turns most characters away before the three kinds of sequences are tried.
    marked = F.regexp_replace(text, f"{MAY_START}(?:{EMOJI})", f"{TEXT_SIGN}$0{TEXT_SIGN}")
    mapped = F.array_join(F.transform(F.split(marked, TEXT_SIGN, -1), replaced), "")
    rest = F.replace(mapped, F.lit(EMOJI_SIGN), F.lit(""))
    return F.when(text.rlike(MAYBE_EMOJI), rest).otherwise(text)

"""Character classes and patterns that mean the same in Java regex and in RE2.

``\\w`` and ``\\s`` differ between engines, so the text functions spell the classes out.
"""

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
NOT_SPACE = r"[^\s\p{Z}\x0b\x1c-\x1f\x85]"

URL = f"http{NOT_SPACE}+|www{NOT_SPACE}+"
MENTION = f"@{WORD}+"
HASHTAG = f"#{WORD}+"
HASHTAG_BODY = f"#({WORD}+)"
HYPHENATED = f"({WORD})-({WORD})"
SPACES = f"{SPACE}+"
TOKEN = f"{WORD}+(?:'{WORD}+)*"
TERM = f"{WORD}{{2,}}"
CLOUD_WORD = f"{WORD}[\\p{{L}}\\p{{N}}_']*"

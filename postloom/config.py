"""Run settings for the preprocessing and labelling plans."""

from __future__ import annotations

from dataclasses import dataclass, field

# The labels of the corpus.
CLASSES = ("positivo", "negativo", "neutro")

# Columns that identify a person.
SENSITIVE = ("id", "name", "screen_name", "location")
# Reply columns also identify a person; pass SENSITIVE + REPLY_COLUMNS to drop them too.
REPLY_COLUMNS = ("in_reply_to_user_id", "in_reply_to_screen_name")

# Place names whose words are glued with an underscore, applied in this order.
COMPOUND_NAMES = (
    "Países Bajos",
    "Costa Rica",
    "Estados Unidos",
    "República Dominicana",
    "Nueva Zelanda",
    "San José",
    "El Salvador",
    "Puerto Rico",
    "Bosnia y Herzegovina",
    "Trinidad y Tobago",
    "Guinea Ecuatorial",
)

# Words left out of the word-frequency report.
REPORT_STOPWORDS = (
    "rt", "https", "co", "que", "de", "el", "la", "en", "los", "las", "un", "una",
    "es", "y", "a", "con", "se", "del", "al", "por", "no", "le", "lo", "su",
)

EMOJI_MODES = ("map", "remove")
HASHTAG_MODES = ("normalize", "remove")
NULL_TEXT_MODES = ("literal", "keep")
STRATEGIES = ("primary", "secondary", "both", "none")


@dataclass(frozen=True)
class PreprocessConfig:
    """Settings of the cleaning, labelling and sampling steps.

    ``null_text="literal"`` turns a null text into the word ``none``;
    ``"keep"`` leaves it null.
    """

    sample_size: int = 500
    seed: int = 42
    lemmatize: bool = False
    emoji_strategy: str = "map"
    hashtag_strategy: str = "normalize"
    label_strategy: str = "both"
    validation_size: int = 150
    null_text: str = "literal"
    compounds: tuple[str, ...] = field(default=COMPOUND_NAMES)

    def __post_init__(self) -> None:
        for name, value, allowed in (
            ("emoji_strategy", self.emoji_strategy, EMOJI_MODES),
            ("hashtag_strategy", self.hashtag_strategy, HASHTAG_MODES),
            ("null_text", self.null_text, NULL_TEXT_MODES),
            ("label_strategy", self.label_strategy.lower(), STRATEGIES),
        ):
            if value not in allowed:
                raise ValueError(f"{name}={value!r}; expected one of {allowed}")

"""Text functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the tokenizer cannot read (emoji and the variation selector).
UNREADABLE = r"[\x{FE0F}\x{1F000}-\x{1F7FF}]"
SENTENCE_END = r"[.!?]+"
TOKEN = r"([a-z']+)"
# An @ that does not follow a word character or another @; led by the literal, which is rare.
MENTION = r"@(?<![\w@]@)(\w+)"


def clean(text: Column) -> Column:
    """Replace every unreadable character by a space."""
    return F.regexp_replace(text, UNREADABLE, " ")


def is_clean(text: Column) -> Column:
    return ~F.rlike(text, F.lit(UNREADABLE))


def assert_clean(text: Column) -> Column:
    """``text`` itself; the job fails on a row that still has unreadable characters."""
    failed = F.raise_error(F.lit("unreadable characters left after cleaning"))
    return F.when(text.isNull() | is_clean(text), text).otherwise(failed.cast("string"))


def sentences(text: Column) -> Column:
    """The non-blank sentences of a text, in order."""
    return F.filter(F.split(clean(text), SENTENCE_END), lambda s: s.rlike(r"\S"))


def lower_words(lowered: Column) -> Column:
    """Words of a text that is in lower case already, in order."""
    return F.regexp_extract_all(lowered, F.lit(TOKEN), 1)


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return lower_words(F.lower(text))


def without_stop_words(words: Column, stop_words: list[str]) -> Column:
    """The words that are not in ``stop_words``, repeats kept."""
    return F.filter(words, lambda w: ~w.isin(stop_words))


def mentions_in(text: Column) -> Column:
    """Handles mentioned in a text, without the ``@``, in order and with repeats."""
    return F.regexp_extract_all(text, F.lit(MENTION), 1)


def fixed(value: Column, decimals: int) -> Column:
    """A number with a fixed count of decimals, half up; ``null`` for NULL."""
    return F.when(value.isNull(), "null").otherwise(F.format_string(f"%.{decimals}f", value))

"""Text clean-up as column expressions: no Python worker, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions import stopwords
from tagloom.functions.lemma import lemmas
from tagloom.functions.patterns import ALLOWED_CHARACTERS, CLEANING_ORDER, KEPT_WORD, PATTERNS


def default_stop_words() -> list[str]:
    """Spark's English stop-word list (about 180 words)."""
    return list(stopwords.ENGLISH)


def remove_pattern(text: Column, flag: str) -> Column:
    """Replace every match of the named pattern by one blank."""
    if flag not in PATTERNS:
        raise ValueError(f"unknown pattern {flag!r}; known: {', '.join(PATTERNS)}")
    return F.regexp_replace(text, PATTERNS[flag], " ")


def clean_up_to(text: Column, flag: str) -> Column:
    """Lower-case, then the named patterns in cleaning order up to and including ``flag``."""
    cleaned = F.lower(text)
    for name in CLEANING_ORDER[: CLEANING_ORDER.index(flag) + 1]:
        cleaned = remove_pattern(cleaned, name)
    return cleaned


def drop_words(text: Column, words: Sequence[str]) -> Column:
    """Split on one blank, drop empty pieces and exact matches of ``words``, join again."""
    return F.array_join(_without(F.split(text, " "), ["", *words]), " ")


def _without(pieces: Column, words: Sequence[str]) -> Column:
    # A long literal list becomes a hash-set lookup (InSet), not a chain of comparisons.
    return F.filter(pieces, lambda word: ~word.isin(*words)) if words else pieces


def clean_words(text: Column, stop_words: Sequence[str]) -> Column:
    """The words that cleaning keeps, in order.

    Equal to ``clean_up_to(text, "white_space")`` followed by the stop words, with one regex
    pass instead of five: once punctuation is blank, the remaining patterns only decide
    whole words. The address pattern runs only on texts that hold one.
    """
    lowered = F.lower(text)
    no_urls = F.when(F.contains(lowered, F.lit("://")), remove_pattern(lowered, "urls")).otherwise(lowered)
    return _without(F.regexp_extract_all(no_urls, F.lit(KEPT_WORD), F.lit(0)), stop_words)


def clean_text(text: Column, stop_words: Sequence[str]) -> Column:
    return F.array_join(clean_words(text, stop_words), " ")


def preprocess_text(text: Column, stop_words: Sequence[str]) -> Column:
    """Clean, then bring every word to its base form."""
    return F.array_join(lemmas(clean_words(text, stop_words)), " ")


def tokens(text: Column) -> Column:
    """Lower-case and split on single white space; an empty text is one empty token."""
    return F.split(F.lower(text), r"\s")


def preprocessed_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """``tokens(preprocess_text(text))``; the text is lower-case with single blanks already."""
    return F.split(preprocess_text(text, stop_words), " ")


def explode_once(words: Column) -> Column:
    """One row per word; a NULL or empty array gives one NULL row.

    The outer form, because for the inner one the optimizer adds a filter on the array's size
    below the generator, which evaluates a computed array several times.
    """
    return F.explode_outer(words)


def text_key(text: Column, name: str = "_key") -> tuple[Column, Column]:
    """``_key_a`` and ``_key_b``, a 128-bit hash of a text or of tokens; equal for equal values."""
    return F.xxhash64(text).alias(f"{name}_a"), F.xxhash64(F.lit(1), text).alias(f"{name}_b")


def comma_pieces(text: Column) -> Column:
    """Split on commas without trailing empty pieces; a text of commas only has none."""
    trimmed = F.rtrim(text, F.lit(","))
    only_commas = (trimmed == "") & (text != "")
    return F.when(only_commas, F.array().cast("array<string>")).otherwise(F.split(trimmed, ","))


def drop_stop_pieces(pieces: Column, stop_words: Sequence[str]) -> Column:
    """Drop the pieces that are, as a whole and in any case, a stop word."""
    lowered = [word.lower() for word in stop_words]
    return F.filter(pieces, lambda piece: ~F.lower(piece).isin(*lowered))


def is_ascii(text: Column) -> Column:
    """Every character is US-ASCII: exactly then a UTF-8 text has one byte per character."""
    return F.octet_length(text) == F.char_length(text)


def has_allowed_characters(text: Column) -> Column:
    # A bare ``$`` would also match before a final line break.
    return F.rlike(text, F.lit(ALLOWED_CHARACTERS.removesuffix("$") + r"\z"))


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def strip_control_characters(text: Column) -> Column:
    """Delete the characters below the blank; the words around a line break are glued."""
    return F.regexp_replace(text, r"[\x00-\x1F]", "")

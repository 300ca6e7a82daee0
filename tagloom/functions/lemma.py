"""Base forms of English words by suffix rules.

The rules are string comparisons on one word, so no word is exploded or shuffled, and only
words that end like an inflected verb meet a regular expression. They expect cleaned text
(lower-case ASCII letters and digits, single blanks).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plural endings that lose their last two letters: classes, boxes, watches, dishes, buzzes.
LONG_PLURALS = ("sses", "xes", "ches", "shes", "zzes")
# Endings in -s that are no plural: glass, bus, basis.
NO_PLURALS = ("ss", "us", "is")

# (pattern, replacement) on a whole word in -ing or -ed, applied in this order. Groups that
# take no part are empty.
VERB_RULES = (
    # rated, enabling, sized, racing, valued, moving -> rate, enable, size, race, value, move
    (r"^([a-z0-9]*(?:[b-df-hj-np-tv-z]at|iz|[aeiouy][a-z0-9]*(?:bl|[cuv])))(?:ing|ed)$", "$1e"),
    # running, planned -> run, plan
    (
        r"^([a-z0-9]*[aeiouy])(?:(b)b|(d)d|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)(?:ing|ed)$",
        "$1$2$3$4$5$6$7$8$9",
    ),
    # playing, matched -> play, match
    (r"^([a-z0-9]*[aeiouy][a-z0-9]+)(?:ing|ed)$", "$1"),
)


def _ends_with(word: Column, endings: tuple[str, ...]) -> Column:
    found = F.endswith(word, F.lit(endings[0]))
    for ending in endings[1:]:
        found = found | F.endswith(word, F.lit(ending))
    return found


def _singular(word: Column) -> Column:
    length = F.length(word)
    return (
        F.when(
            F.endswith(word, F.lit("ies")) & (length >= 5),
            F.concat(F.substring(word, F.lit(1), length - 3), F.lit("y")),
        )
        .when(_ends_with(word, LONG_PLURALS), F.substring(word, F.lit(1), length - 2))
        .when((length >= 4) & ~_ends_with(word, NO_PLURALS), F.substring(word, F.lit(1), length - 1))
        .otherwise(word)
    )


def _infinitive(word: Column) -> Column:
    for pattern, replacement in VERB_RULES:
        word = F.regexp_replace(word, pattern, replacement)
    return word


def lemma(word: Column) -> Column:
    """The base form of one word."""
    return (
        F.when(F.endswith(word, F.lit("s")), _singular(word))
        .when(_ends_with(word, ("ing", "ed")), _infinitive(word))
        .otherwise(word)
    )


def lemmas(words: Column) -> Column:
    """The base form of every word of an array."""
    return F.transform(words, lemma)

"""Language detection: character n-gram profiles learnt from labelled text, scored by Bayes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.ranking import best_index, label_at, rounded
from tagloom.functions.text import explode_once
from tagloom.operators import bayes

PROFILE_SMOOTHING = 1.0
PROFILE_FEATURES = 65_536
# Log odds of the two best languages for 99.99 % confidence; anything less is undecided.
MIN_MARGIN = 9.21


def only_letters(text: Column) -> Column:
    """The lower-cased words of letters, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def gram_counts(docs: DataFrame, text_col: str, lang_col: str, grams: Callable[[Column], Column]) -> DataFrame:
    """``(label, term, n)`` of the grams of texts with a language; NULL terms hold the document counts.

    No gram reaches from one word into the next: the words are counted first, and grams are cut from
    distinct words only.
    """
    marker = F.array(F.lit(None).cast("string"))
    words = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("label"),
        explode_once(F.concat(marker, F.split(only_letters(F.col(text_col)), " "))).alias("word"),
    )
    counted = words.groupBy("label", "word").agg(F.count(F.lit(1)).alias("uses"))
    terms = F.when(F.col("word").isNull(), marker).otherwise(grams(F.col("word")))
    cut = counted.select("label", "uses", F.explode(terms).alias("term"))
    return cut.groupBy("label", "term").agg(F.sum("uses").alias("n"))


def trigrams(text: Column) -> Column:
    """Overlapping three-character grams of the whole text, in one pass.

    Anything but letters becomes one blank; grams with a blank in the middle are left out,
    those that begin or end a word stay.
    """
    padded = F.concat(F.lit(" "), only_letters(text), F.lit(" "))
    return F.regexp_extract_all(padded, F.lit(r"(?=(.[^ ].))"), F.lit(1))


def language_profiles(docs: DataFrame, text_col: str, lang_col: str) -> bayes.BayesModel:
    """Gram counts per language over whole texts; no language is likelier beforehand."""
    counts = gram_counts(docs, text_col, lang_col, trigrams)
    return bayes.fit_counts(counts, PROFILE_SMOOTHING, PROFILE_FEATURES, uniform_priors=True)


def detect_language(
    docs: DataFrame,
    profiles: bayes.BayesModel,
    id_col: str,
    text_col: str,
    min_margin: float = MIN_MARGIN,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(id, *carry, lang_pred)`` of every record; NULL where the two best languages are closer than ``min_margin``."""
    grams = docs.select(id_col, *carry, trigrams(F.col(text_col)).alias("tokens"))
    scored = bayes.class_scores(grams, profiles, id_col, carry=carry)
    scores = F.col("scores")
    best = label_at(best_index(scores), profiles.labels)
    if len(profiles.classes) == 1:
        return scored.select(id_col, *carry, best.alias("lang_pred"))
    ordered = F.sort_array(rounded(scores), asc=False)
    decided = ordered[0] - ordered[1] >= F.lit(min_margin)
    return scored.select(id_col, *carry, F.when(decided, best).alias("lang_pred"))

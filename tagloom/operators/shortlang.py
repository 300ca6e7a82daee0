"""Language of short texts: grams of one to three letters, posterior probabilities, undecided as NULL.

Every gram multiplies the probability of each language by its share among the language's grams of that
length, plus a floor for grams the language lacks; grams that no language has say nothing. The language
is decided when its posterior is nearly certain. Factors are fixed-point logarithms (millionths), so the
product is a sum that any engine adds up exactly, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.ranking import label_at
from tagloom.operators.bayes import sum_weights
from tagloom.operators.langid import gram_counts, only_letters
from tagloom.shared import BROADCAST_BYTES, materialize

# Fixed values. The floor that a gram adds in every language, and the posterior that decides.
FLOOR = 0.5 / 10_000
CERTAIN = 0.9999
SCALE = 1_000_000


@dataclass(frozen=True)
class ShortProfiles:
    """``factors(term, weights)``: one fixed-point log factor per language, in order."""

    languages: tuple[str, ...]
    factors: DataFrame


def grams(text: Column) -> Column:
    """All grams of one to three characters of the words; blanks only at the ends of a gram."""
    padded = F.concat(F.lit(" "), only_letters(text), F.lit(" "))
    found = [
        F.regexp_extract_all(padded, F.lit(pattern), F.lit(1))
        for pattern in (r"([^ ])", r"(?=(.[^ ]|[^ ].))", r"(?=(.[^ ].))")
    ]
    return F.concat(*found)


def profiles(docs: DataFrame, text_col: str, lang_col: str) -> ShortProfiles:
    """Gram shares of every language, over whole texts; rows without text or language teach nothing."""
    counted = gram_counts(docs, text_col, lang_col, grams).withColumnRenamed("label", "lang")
    counts = materialize(counted.where(F.col("term").isNotNull()), "gram-counts")
    length = F.char_length("term").alias("length")
    totals = {(r.lang, r.length): r.n for r in counts.groupBy("lang", length).agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted({lang for lang, _ in totals}))
    if not languages:
        raise ValueError("no text with a language to learn from")
    sums = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)]

    def factor(i: int) -> Column:
        # A language may lack grams of a length altogether.
        per_length = F.lit([float(totals.get((languages[i], k), 1)) for k in (1, 2, 3)])
        share = F.col(f"n{i}") / F.get(per_length, F.char_length("term") - 1)
        return F.round(F.log(share + F.lit(FLOOR)) * F.lit(float(SCALE)))

    table = counts.groupBy("term").agg(F.sum("n").alias("total"), *sums).select(
        "term", "total", F.array(*[factor(i) for i in range(len(languages))]).alias("weights")
    )
    return ShortProfiles(languages, materialize(table, "gram-factors"))


def detect_language_short(
    docs: DataFrame,
    known: ShortProfiles,
    id_col: str,
    text_col: str,
    carry: Sequence[str] = (),
    certain: float = CERTAIN,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, *carry, lang_pred)`` of every record; NULL where no language is certain, as without letters."""
    tokens = docs.select(id_col, *carry, grams(F.col(text_col)).alias("tokens"))
    size = len(known.languages)
    summed = sum_weights(tokens, known.factors, size, id_col, "tokens", carry, broadcast_bytes)
    own = F.transform("_sums", lambda total: total / F.col("_copies"))
    best = F.array_max(own)
    # Shares relative to the best language: their sum is one over its posterior.
    rest = F.aggregate(own, F.lit(0.0), lambda sum_, x: sum_ + F.exp((x - best) / F.lit(float(SCALE))))
    decided = F.when(1 / rest >= F.lit(certain), label_at(F.array_position(own, best).cast("int") - 1, known.languages))
    each = summed.select(
        id_col, *carry, decided.alias("lang_pred"), F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))
    )
    return each.select(id_col, *carry, "lang_pred")

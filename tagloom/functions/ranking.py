"""Ordering of class scores held in one array per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits that take part in comparisons, so the order of float additions cannot break a tie.
RANK_DIGITS = 6


def rounded(scores: Column) -> Column:
    return F.transform(scores, lambda score: F.round(score, RANK_DIGITS))


def best_index(scores: Column) -> Column:
    """Position of the greatest score; the first one among equals."""
    comparable = rounded(scores)
    return (F.array_position(comparable, F.array_max(comparable)) - 1).cast("int")


def ranked(scores: Column, labels: Sequence[str]) -> Column:
    """All (score, label_idx, label), best first; the higher index first among equals."""
    names = F.lit(list(labels))

    def entry(score: Column, index: Column) -> Column:
        return F.struct(
            F.round(score, RANK_DIGITS).alias("score"),
            index.alias("label_idx"),
            F.get(names, index).alias("label"),
        )

    return F.sort_array(F.transform(scores, entry), asc=False)


def top_labels(scores: Column, labels: Sequence[str], k: int) -> Column:
    """The labels of the ``k`` best scores; all for a larger ``k``, none for ``k <= 0``."""
    if k <= 0:
        return F.array().cast("array<string>")
    return F.slice(ranked(scores, labels).getField("label"), 1, k)


def label_at(index: Column, labels: Sequence[str]) -> Column:
    return F.get(F.lit(list(labels)), index)


def index_of(label: Column, labels: Sequence[str]) -> Column:
    """Position of a label; NULL for one the model has not seen."""
    position = F.array_position(F.lit(list(labels)), label)
    return F.when(position > 0, (position - 1).cast("int"))

"""A word table packed into one row, so that words are looked up where they stand.

The row is an array of slots; the slot a word's hash names holds the few words that share it, with their values.
It reaches the tasks as a scalar subquery, like a Bloom filter: texts are answered in an array expression, without
rows of words, joins or exchanges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that share a slot, about.
SLOT_WORDS = 2


@dataclass(frozen=True)
class PackedTable:
    """``table`` is one row with the array ``slots`` of maps; a slot without words is NULL."""

    table: DataFrame
    slots: int

    def select(
        self, rows: DataFrame, kept: Sequence[str], answer: Callable[[Callable[[Column], Column]], Column], name: str
    ) -> DataFrame:
        """``rows`` with the columns ``kept`` and the array ``answer(value_of)`` as ``name``.

        ``value_of(word)`` is a word's value, NULL for a word that is not in the table.
        """

        def answered(held: Column) -> Column:
            return answer(lambda word: F.element_at(F.get(held, _slot(word, self.slots)), word))

        # Lambdas take no subquery: it is named below them, and the optimizer, as it is used once, puts it in its
        # place, so no row holds it. An array of one element binds it for all words of a row.
        held = rows.select("*", self.table.select("slots").scalar().alias("_packed"))
        return held.select(*kept, F.flatten(F.transform(F.array("_packed"), answered)).alias(name))


def pack(entries: DataFrame) -> PackedTable:
    """The written table ``entries(word, _value)``, one row a word, as one row: for tables that may be broadcast."""
    slots, wanted = 1, entries.count() // SLOT_WORDS
    while slots < wanted:
        slots *= 2
    none = entries.sparkSession.range(slots).select(
        F.col("id").cast("int").alias("slot"), F.lit(None).cast(_entry_type(entries)).alias("entry")
    )
    filled = entries.where(F.col("word").isNotNull()).select(
        _slot(F.col("word"), slots).alias("slot"), F.struct("word", "_value").alias("entry")
    )
    # NULLs are not collected.
    by_slot = none.unionAll(filled).groupBy("slot").agg(F.collect_list("entry").alias("held"))
    in_order = F.array_sort(F.collect_list(F.struct("slot", "held")))
    maps = F.transform(in_order, lambda slot: F.when(F.size(slot["held"]) > 0, F.map_from_entries(slot["held"])))
    return PackedTable(by_slot.agg(maps.alias("slots")), slots)


def _entry_type(entries: DataFrame) -> str:
    kinds = dict(entries.dtypes)
    return f"struct<word:{kinds['word']},_value:{kinds['_value']}>"


def _slot(word: Column, slots: int) -> Column:
    """Slot of a word; ``slots`` is a power of two."""
    return F.shiftright(F.xxhash64(word), 20).bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")

"""A Bloom filter of a word table: rules words out before they are shuffled.

The filter is an array of 64-bit slots in one row. A word sets three bits of the slot its hash names, so a
test reads one slot; with twelve bits a word about one unlisted word in thirty passes. It reaches the tasks as a
scalar subquery: no join, and a filter in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_WORD = 12
# 16 MB; larger tables get a filter that lets more words pass, never one that drops a listed word.
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class BloomFilter:
    """``table`` is one row with the array ``bits``."""

    table: DataFrame
    slots: int

    def may_contain(self, word: Column) -> Column:
        """False only for words that are not in the table; never NULL."""
        slot, mask = _place(word, self.slots)
        bits = F.get(self.table.select("bits").scalar(), slot)
        return F.coalesce(bits.bitwiseAND(mask) == mask, F.lit(False))


def bloom_filter(words: DataFrame, word_col: str = "word", max_bits: int = MAX_BITS) -> BloomFilter:
    """The filter of a written table of distinct words; its size follows their number up to ``max_bits``."""
    slots = 1
    wanted = min(max_bits, words.count() * BITS_PER_WORD)
    while slots * 64 < wanted:
        slots *= 2
    slot, mask = _place(F.col(word_col), slots)
    none = words.sparkSession.range(slots).select(
        F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("bits")
    )
    filled = words.where(F.col(word_col).isNotNull()).select(slot.alias("slot"), mask.alias("bits"))
    merged = none.unionAll(filled).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("slot", "bits")))
    return BloomFilter(merged.agg(in_order.getField("bits").alias("bits")), slots)


def _place(word: Column, slots: int) -> tuple[Column, Column]:
    """Slot of a word and the bits it sets there; ``slots`` is a power of two."""
    name = F.xxhash64(word)
    mask = F.lit(0).cast("long")
    for k in range(3):
        bit = F.shiftright(name, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    slot = F.shiftright(name, 20).bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")
    return slot, mask

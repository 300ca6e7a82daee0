"""Joins on words, whose frequent ones would fill a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.bloom import bloom_filter
from tagloom.shared import BROADCAST_BYTES, ROW_BYTES, broadcast_size, materialize

# Words that at least one in so many rows hold are hot: there cannot be more of them.
HOT_SHARE = 4096

# Steps of a doubling by which words are ranked: a rank is one row of the driver's, some hundreds in all.
RANKS = 16


def common_entries(
    entries: DataFrame, words: DataFrame, room: int, row_bytes: int = ROW_BYTES
) -> tuple[DataFrame, DataFrame | None]:
    """``entries(word, _value)`` of the words commonest in ``words(word)``, as many as fit ``room`` bytes, and the others.

    A table that fits is returned whole, and None for the others. Words are counted, all of them, only for
    a larger one. ``row_bytes`` is what an entry takes beyond its strings.
    """
    strings = [name for name, kind in entries.dtypes if kind == "string"]
    if broadcast_size(entries, *strings, row_bytes=row_bytes) <= room:
        return entries, None
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.coalesce(F.floor(F.log2("n") * RANKS), F.lit(-1)).cast("int").alias("_rank")
    ranked = materialize(entries.join(counts, "word", "left").select(*entries.columns, rank), "ranked-entries")
    size = F.lit(row_bytes).cast("long")
    for name in strings:
        size = size + F.coalesce(F.octet_length(name), F.lit(0))
    sizes = {row._rank: row.size for row in ranked.groupBy("_rank").agg(F.sum(size).alias("size")).collect()}
    taken, least = 0, max(sizes, default=0) + 1
    for found in sorted(sizes, reverse=True):
        taken += sizes[found]
        if taken > room:
            break
        least = found
    near = ranked.where(F.col("_rank") >= least).drop("_rank")
    return near, ranked.where(F.col("_rank") < least).drop("_rank")


def join_entries(
    found: DataFrame,
    entries: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """``found(word, ...)`` joined with ``entries(word, _value)``, one entry a word; unlisted words go.

    ``row_bytes`` is what an entry takes beyond its strings.

    Entries that fit are broadcast. Of a larger table a Bloom filter rules out the unlisted words where
    they stand; of those that pass, the hot ones meet a broadcast of their entries, at most ``HOT_SHARE``
    rows whatever the input, and the others are shuffled, none of them often enough to fill a task.
    """
    strings = [name for name, kind in entries.dtypes if kind == "string"]
    if broadcast_size(entries, *strings, row_bytes=row_bytes) <= broadcast_bytes:
        return found.join(F.broadcast(entries), "word")
    listed = bloom_filter(entries)
    passed = materialize(found.where(listed.may_contain(F.col("word"))), "listed-words")
    counts = passed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(
        counts.where(F.col("n") * HOT_SHARE >= F.lit(passed.count())).select("word"), "hot-words"
    )
    near = passed.join(F.broadcast(entries.join(F.broadcast(hot), "word")), "word")
    far = passed.join(F.broadcast(hot), "word", "left_anti").join(
        entries.join(F.broadcast(hot), "word", "left_anti").hint("shuffle_hash"), "word"
    )
    return near.unionByName(far)

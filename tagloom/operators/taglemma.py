"""Base forms by word and tag: edit scripts learnt from listed words, found by a word's longest known ending.

A script says how many letters a word loses at its end and what it gets instead. Every ending of every
listed word, up to ``LONGEST`` letters and the word itself, votes for its script; the winners are a trie,
kept as one row per node ``(ending, tag)``. A word takes the script of its deepest node. All of it works on
distinct words, as joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.hotkeys import join_entries
from tagloom.shared import BROADCAST_BYTES, materialize

LONGEST = 6
# Votes that an inner node needs; words themselves and the root stand with one.
SUPPORT = 2
# Stands before a whole word, which is no ending of another one.
WHOLE = "^"


def edit_script(word: Column, lemma: Column) -> Column:
    """``struct(cut, add)`` that turns the word into its lemma."""
    shorter = F.least(F.length(word), F.length(lemma))
    same = F.when(
        shorter > 0,
        F.size(
            F.filter(
                F.sequence(F.lit(1), shorter),
                lambda i: F.substring(word, F.lit(1), i) == F.substring(lemma, F.lit(1), i),
            )
        ),
    ).otherwise(0)
    return F.struct(
        (F.length(word) - same).alias("cut"), F.substring(lemma, same + 1, F.length(lemma)).alias("add")
    )


def _nodes(word: Column) -> Column:
    """All trie nodes of a word as ``struct(depth, ending)``; the word itself is the deepest."""
    depths = F.sequence(F.lit(0), F.least(F.length(word), F.lit(LONGEST)))
    endings = F.transform(
        depths,
        lambda n: F.struct(
            n.alias("depth"), F.substring(word, F.length(word) - n + 1, n).alias("ending")
        ),
    )
    whole = F.struct(F.lit(LONGEST + 1).alias("depth"), F.concat(F.lit(WHOLE), word).alias("ending"))
    return F.concat(endings, F.array(whole))


def _key(ending: Column, tag: Column) -> Column:
    return F.concat(tag, F.lit("\t"), ending)


def learn(listed: DataFrame) -> DataFrame:
    """The trie ``(node, cut, add)`` of ``listed(word, tag, lemma)``; rows with a NULL teach nothing.

    Of the scripts of a node the one with the most votes wins, then the one that cuts less, then by letters.
    """
    known = listed.select("word", "tag", "lemma").dropna().distinct()
    votes = known.select(
        "tag", edit_script(F.col("word"), F.col("lemma")).alias("script"), F.inline(_nodes(F.col("word")))
    )
    counted = votes.groupBy("tag", "ending", "depth", "script").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("tag", "ending", "depth").agg(
        F.sum("n").alias("votes"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("script.cut").alias("cut"), F.col("script.add").alias("add"))).alias("best"),
    )
    kept = best.where((F.col("votes") >= SUPPORT) | F.col("depth").isin(0, LONGEST + 1))
    return materialize(
        kept.select(_key(F.col("ending"), F.col("tag")).alias("node"), "best.cut", "best.add"), "lemma-trie"
    )


def lemmatize_tagged(
    words: DataFrame, trie: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(word, tag, lemma)`` of distinct ``words(word, tag)``; a word of an unknown tag stays as it is.

    The root of a tag is a node of all its words, a hot key: ``join_entries`` broadcasts it.
    """
    pairs = words.select("word", "tag").where(F.col("word").isNotNull()).distinct()
    nodes = pairs.where(F.col("tag").isNotNull()).select(
        F.col("word").alias("_of"), "tag", F.inline(_nodes(F.col("word")))
    )
    found = nodes.select("_of", "tag", "depth", _key(F.col("ending"), F.col("tag")).alias("word"))
    entries = trie.select(
        F.col("node").alias("word"), F.concat(F.col("cut"), F.lit(":"), F.col("add")).alias("_value")
    )
    hits = join_entries(found, entries, broadcast_bytes)
    deepest = hits.groupBy(F.col("_of").alias("word"), "tag").agg(F.max_by("_value", "depth").alias("_script"))
    cut = F.substring_index("_script", ":", 1).cast("int")
    add = F.substring(F.col("_script"), F.instr("_script", ":") + 1, F.length("_script"))
    word = F.col("word")
    formed = F.when(
        F.coalesce(cut <= F.length(word), F.lit(False)),
        F.concat(F.substring(word, F.lit(1), F.length(word) - cut), add),
    ).otherwise(word)
    return pairs.join(deepest, ["word", "tag"], "left").select("word", "tag", formed.alias("lemma"))

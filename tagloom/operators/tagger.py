"""A sequence tagger: a hidden Markov model counted from tagged texts, decoded by Viterbi.

A text's tags are a chain; each word depends on its tag only. Chains and words are counted in single
aggregations. A word that the model has not seen is judged by its longest known ending of up to three
letters, counted over the rare words of the training texts, as new words are like rare ones.

Probabilities are fixed-point logarithms (millionths), so paths have exact scores: equal ones are told
apart by the lower tag, and any engine finds the same path. Emissions of words meet the texts by the
piecewise lookup of ``lexicon``; a map over Arrow batches then walks all texts of a batch step by step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.lexicon import look_up, vocabulary
from tagloom.shared import BROADCAST_BYTES, ROW_BYTES, materialize

SCALE = 1_000_000
SMOOTHING = 0.1
# Words that occur so often at most are rare, and their endings stand for those of new words.
RARE = 10
ENDINGS = (3, 2, 1)
# A tag set is a list that the driver holds; its transitions are its square.
MOST_TAGS = 256


@dataclass(frozen=True)
class Tagger:
    """``emissions(word, _value)`` and ``endings(ending, _value)`` hold one score per tag, in order."""

    tags: tuple[str, ...]
    start: tuple[int, ...]
    moves: tuple[tuple[int, ...], ...]
    emissions: DataFrame
    endings: DataFrame


def _log(count: Column, total: Column, kinds: Column) -> Column:
    ratio = (count + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING) * kinds)
    return F.round(F.log(ratio) * F.lit(float(SCALE))).cast("long")


def fit(tagged: DataFrame, words_col: str = "words", tags_col: str = "tags") -> Tagger:
    """Count a table of texts, each an array of words and an array of as many tags.

    Rows without words or tags teach nothing; a NULL word or tag ends no chain but is not counted.
    """
    rows = tagged.select(F.col(words_col).alias("words"), F.col(tags_col).alias("tags"))
    pairs = rows.select(F.inline_outer(F.arrays_zip("words", "tags"))).where(
        F.col("words").isNotNull() & F.col("tags").isNotNull()
    )
    counts = materialize(
        pairs.groupBy(F.col("words").alias("word"), F.col("tags").alias("tag")).agg(
            F.count(F.lit(1)).alias("n")
        ),
        "tagged-words",
    )
    by_tag = {row.tag: row.n for row in counts.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    tags = tuple(sorted(by_tag))
    if not tags or len(tags) > MOST_TAGS:
        raise ValueError(f"{len(tags)} tags; a tagger takes 1 to {MOST_TAGS}")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("tags", 1, F.greatest(F.size("tags") - 1, F.lit(0))))
    steps = rows.where(F.size("tags") > 0).select(
        F.inline(F.arrays_zip(before.alias("a"), F.col("tags").alias("b")))
    )
    moved = {(r.a, r.b): r.n for r in steps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}

    def fixed(count: int, total: int) -> int:
        ratio = (count + SMOOTHING) / (total + SMOOTHING * len(tags))
        return int(np.floor(np.log(ratio) * SCALE + 0.5))

    def row(a: str | None) -> tuple[int, ...]:
        total = sum(moved.get((a, b), 0) for b in tags)
        return tuple(fixed(moved.get((a, b), 0), total) for b in tags)

    kinds = counts.select("word").distinct().count()
    emissions = _scores(counts, "word", tags, by_tag, kinds)
    return Tagger(tags, row(None), tuple(row(a) for a in tags), materialize(emissions, "emissions"), _endings(counts, tags))


def _scores(
    counts: DataFrame, key: str, tags: tuple[str, ...], totals: dict[str, int], kinds: int
) -> DataFrame:
    """``(key, _value)`` from ``(key, tag, n)``: the fixed-point log of each tag's share."""
    per_tag = [F.sum(F.when(F.col("tag") == tag, F.col("n")).otherwise(0)).alias(f"n{i}") for i, tag in enumerate(tags)]
    grouped = counts.groupBy(key).agg(*per_tag)
    values = [
        _log(F.col(f"n{i}"), F.lit(totals.get(tag, 0)), F.lit(kinds + 1)) for i, tag in enumerate(tags)
    ]
    return grouped.select(key, F.array(*values).alias("_value"))


def _endings(counts: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """``(ending, _value)`` of all endings of rare words."""
    often = counts.groupBy("word").agg(F.sum("n").alias("_all"))
    rare = materialize(counts.join(often.where(F.col("_all") <= RARE), "word"), "rare-words")
    totals = {r.tag: r.n for r in rare.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    tables = None
    for length in ENDINGS:
        ended = rare.where(F.length("word") >= length).groupBy(
            F.substring("word", -length, length).alias("ending"), "tag"
        ).agg(F.sum("n").alias("n"))
        ended = materialize(ended, "endings")
        table = _scores(ended, "ending", tags, totals, ended.select("ending").distinct().count())
        tables = table if tables is None else tables.unionByName(table)
    return materialize(tables, "endings")


def word_scores(words: DataFrame, model: Tagger) -> DataFrame:
    """``(word, _value)`` of a table of distinct words; without known ending all tags score 0."""
    known = words.join(model.emissions, "word")
    new = words.join(model.emissions, "word", "left_anti")
    for length in ENDINGS:
        # Short strings; their number follows the alphabet, and Spark knows the size of the table.
        of_length = model.endings.where(F.length("ending") == length).select(
            F.col("ending").alias(f"_ending{length}"), F.col("_value").alias(f"_value{length}")
        )
        ending = F.when(F.length("word") >= length, F.substring("word", -length, length))
        new = new.withColumn(f"_ending{length}", ending).join(of_length, f"_ending{length}", "left")
    none = F.array(*[F.lit(0).cast("long") for _ in model.tags])
    judged = new.select("word", F.coalesce(*[f"_value{length}" for length in ENDINGS], none).alias("_value"))
    return known.select("word", "_value").unionByName(judged)


def tag_sequence(
    docs: DataFrame,
    model: Tagger,
    id_col: str,
    text_col: str,
    out_col: str = "tags",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(id, tags)``: the likeliest tags of the blank-separated words, joined by blanks; NULL for a NULL text."""
    tokens = docs.select(F.split(F.rtrim(F.col(text_col), F.lit(" ")), " ").alias("tokens"))
    entries = materialize(word_scores(vocabulary(tokens), model), "word-scores")
    row_bytes = ROW_BYTES + 8 * len(model.tags)
    found = look_up(docs, id_col, text_col, entries, lambda word, value: value, broadcast_bytes, row_bytes)
    kind = dict(docs.dtypes)[id_col]
    return found.select(id_col, "_out").mapInArrow(
        _decoder(model, id_col, out_col), f"`{id_col}` {kind}, `{out_col}` string"
    )


def _decoder(model: Tagger, id_col: str, out_col: str):
    tags, start, moves = np.array(model.tags, object), np.array(model.start), np.array(model.moves)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = batch.column(1)
            flat = scores.flatten()
            lengths = np.nan_to_num(np.asarray(scores.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), len(tags))
            names = tags[viterbi(values, lengths, start, moves)] if len(flat) else []
            ends = np.cumsum(lengths)
            texts = [
                " ".join(names[end - n : end]) if valid else None
                for n, end, valid in zip(lengths, ends, scores.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, out_col])

    return decoded


def viterbi(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tag of every word of texts that stand one after the other; the lower tag among equals.

    All texts are walked together, one word a step; the longest first, so that those still
    going are a prefix of the arrays.
    """
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    back = np.zeros((len(scores), len(start)), np.int16)
    longest = int(sizes[0]) if len(sizes) else 0
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")
    state = np.zeros((len(sizes), len(start)), np.int64)
    for i in range(longest):
        n = going[i]
        at = begins[:n] + i
        if i == 0:
            state[:n] = start + scores[at]
            continue
        reached = state[:n, :, None] + moves[None]
        back[at] = reached.argmax(axis=1)
        state[:n] = reached.max(axis=1) + scores[at]
    best = state.argmax(axis=1)
    out = np.zeros(len(scores), np.int64)
    for i in range(longest - 1, -1, -1):
        n = going[i]
        at = begins[:n] + i
        out[at] = best[:n]
        best[:n] = back[at, best[:n]]
    return out


def tagged_rows(docs: DataFrame, words: Column, tag: Column) -> DataFrame:
    """``(words, tags)`` of texts all of whose words carry one tag."""
    return docs.select(words.alias("words"), F.transform(words, lambda _: tag).alias("tags"))


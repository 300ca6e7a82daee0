"""Benchmark decontamination: edit distance by way of Hamming distance.

A document leaks an item when some passage of it turns into the item's words (both lower-cased)
with at most ``EDITS`` of the item's number of words inserted, deleted or replaced.

* Where: an edit destroys at most two of the item's word pairs, so a leaking passage still
  holds ``n - 1 - 2 * edits`` pairs of it, repeated ones counted as often as they occur, and all
  but ``2 * edits`` of its different pairs. Every place of a text with as many of an item is found.
  An item of one word has no pairs; its word is looked up.
* Which: in those places item-sized windows and the items walk through the CGK embedding, where
  a few edits become a few unequal places. Windows and items with equal samples of
  ``SAMPLED`` places, in any of ``WALKS * SAMPLES`` repetitions, are candidates.
* Confirmed: the exact edit distance of a candidate, and of the item whose pairs led to the place,
  against the text around the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import tables, texts
from tagloom.shared import materialize

EDITS = 0.2
WALKS = 12
# Length of the walk against that of the run; after twice the length it has mostly ended.
WALKED = 1.6
SAMPLES = 6
SAMPLED = 3
# Items whose tables are broadcast at once; a larger benchmark takes several passes.
SLICE_ITEMS = 20_000
# Windows that are embedded at once, and words of a text that an item is aligned with at once.
WINDOWS = 2048
ALIGNED_WORDS = 1 << 15
# Slots of the bitmap that rules out most word pairs of a text.
SEEN_BITS = 22
LEAKS = "doc_id long, item_id long, edits int, item_words int, start_word long, end_word long"


@dataclass(frozen=True)
class Items:
    """A slice of the benchmark: word hashes, and the embedding's keys in order."""

    ids: np.ndarray
    words: list[np.ndarray]
    pairs: np.ndarray
    pair_items: np.ndarray
    distinct: np.ndarray
    single_words: np.ndarray
    single_items: np.ndarray
    seen: np.ndarray
    keys: np.ndarray
    key_items: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(w) for w in self.words])


def walk(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of the runs from ``starts``: ``WALKED`` times as many word hashes.

    Step j writes the current word and goes on to the next one if a random bit of (j, word) is
    set; behind the end 0 is written.
    """
    steps = int(WALKED * int(lengths.max(initial=1))) + 1
    factors = texts.constants(steps, 900 + seed)
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    at = np.zeros(len(starts), np.int64)
    out = np.zeros((len(starts), steps), np.uint64)
    for j in range(steps):
        inside = at < lengths
        word = np.where(inside, padded[np.minimum(starts + at, len(words))], np.uint64(0))
        out[:, j] = word
        at += (word * factors[j] >> np.uint64(63)).astype(np.int64)
    return out


def embedding_keys(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``(run, WALKS * SAMPLES)`` hashes of sampled embedding places, scaled to the length."""
    out = np.zeros((len(starts), WALKS * SAMPLES), np.uint64)
    for k in range(WALKS):
        embedded = walk(words, starts, lengths, k + 1)
        for s in range(SAMPLES):
            repetition = k * SAMPLES + s
            # Positions are uniform below 1; a run's own length tells which place they name.
            unit = texts.mix(np.arange(SAMPLED, dtype=np.uint64), 500 + repetition) >> np.uint64(40)
            place = (unit[None, :].astype(np.float64) / 2**24 * WALKED * lengths[:, None]).astype(np.int64)
            values = np.take_along_axis(embedded, place, axis=1)
            key = np.full(len(starts), repetition + 1, np.uint64)
            for c in range(SAMPLED):
                key = texts.mix(key ^ values[:, c], 700 + c)
            out[:, repetition] = texts.mix(key ^ lengths.astype(np.uint64), 800)
    return out


def index_items(ids: list[int], items: list[str]) -> Items:
    split = texts.split_words(pc.utf8_lower(pa.array(items, pa.string())))
    hashes = split.hashes()
    kept = [i for i in range(len(ids)) if split.first[i + 1] > split.first[i]]
    words = [hashes[split.first[i] : split.first[i + 1]] for i in kept]
    pairs = [np.unique(pairs_of(w)) for w in words]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for length in np.unique(lengths):
        of = np.flatnonzero(lengths == length)
        made = embedding_keys(flat, starts[of], lengths[of])
        keys.append(made.ravel())
        owners.append(np.repeat(of, made.shape[1]))
    order = np.argsort(np.concatenate(keys), kind="stable")
    flat_pairs = np.concatenate([np.zeros(0, np.uint64), *pairs])
    pair_order = np.argsort(flat_pairs, kind="stable")
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[flat_pairs >> np.uint64(64 - SEEN_BITS)] = True
    single = np.flatnonzero(lengths == 1)
    single_words = flat[starts[single]]
    single_order = np.argsort(single_words, kind="stable")
    return Items(
        np.array(ids, np.int64)[kept],
        words,
        flat_pairs[pair_order],
        np.repeat(np.arange(len(words)), [len(p) for p in pairs])[pair_order],
        np.array([len(p) for p in pairs], np.int64),
        single_words[single_order],
        single[single_order],
        seen,
        np.concatenate(keys)[order],
        np.concatenate(owners)[order],
    )


def allowed(length: int) -> int:
    return int(EDITS * length)


def best_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn a passage of ``text`` into ``item``, and the passage's bounds."""
    n = len(text)
    place = np.arange(n + 1)
    # The cost and the start of the passage in one number: the least cost, then the last start.
    shift = n + 1
    best = n - place
    for word in item:
        replaced = best[:-1] + np.where(text == word, 0, shift)
        row = best + shift
        row[1:] = np.minimum(row[1:], replaced)
        best = np.minimum.accumulate(row - place * shift) + place * shift
    end = int(best.argmin())
    return int(best[end]) // shift, n - int(best[end]) % shift, end


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return texts.runs_hashes(words, 2) if len(words) > 1 else words[:0]


def least_pairs(length: int) -> int:
    """Pairs of an item that its leaks still hold, each counted as often as it occurs."""
    return max(1, length - 1 - 2 * allowed(length))


def places(at: np.ndarray, pair: np.ndarray, length: int, distinct: int) -> list[tuple[int, int]]:
    """Bounds of the stretches in which a passage of an item may lie.

    ``at`` are the places of the item's pairs in a text, in order, ``pair`` which pairs they are,
    ``distinct`` how many different ones the item has.
    """
    least, reach = least_pairs(length), length + allowed(length)
    if len(np.unique(pair)) < distinct - 2 * allowed(length):
        return []
    ahead = np.searchsorted(at, at + reach) - np.arange(len(at))
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(ahead >= least).tolist():
        low, high = int(at[i]) - reach, int(at[i]) + 2 * reach
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def held_pairs(pairs: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """``(place, item, pair)`` of every pair of a text that items hold, by place."""
    place = np.flatnonzero(items.seen[pairs >> np.uint64(64 - SEEN_BITS)])
    left = np.searchsorted(items.pairs, pairs[place], side="left")
    n = np.searchsorted(items.pairs, pairs[place], side="right") - left
    index = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return np.repeat(place, n), items.pair_items[index], items.pairs[index]


def held_words(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """``(place, item)`` of every word of a text that is a whole item, by place."""
    left = np.searchsorted(items.single_words, words, side="left")
    n = np.searchsorted(items.single_words, words, side="right") - left
    index = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(np.arange(len(words)), n), items.single_items[index]


def window_items(words: np.ndarray, low: int, high: int, length: int, items: Items) -> set[int]:
    """Items that share a key with some window of ``length`` words; ``WINDOWS`` of them at a time."""
    found: set[int] = set()
    stop = max(low + 1, high - length // 2)
    for first in range(low, stop, WINDOWS):
        n = min(WINDOWS, stop - first)
        part = words[first : first + n + length]
        keys = np.unique(embedding_keys(part, np.arange(n), np.full(n, length)))
        left = np.searchsorted(items.keys, keys, side="left")
        right = np.searchsorted(items.keys, keys, side="right")
        for h in np.flatnonzero(right > left):
            found.update(items.key_items[left[h] : right[h]].tolist())
    return found


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """``best_passage`` of a text of any length, in stretches that overlap by a leak's greatest length."""
    overlap = len(item) + allowed(len(item)) + 1
    step = max(ALIGNED_WORDS, 4 * overlap)
    if len(text) <= step + overlap:
        return best_passage(item, text)
    best: tuple[int, int, int] | None = None
    for first in range(0, len(text) - overlap, step):
        edits, start, end = best_passage(item, text[first : first + step + overlap])
        # The least edits, then the last start, as within a stretch.
        if best is None or (edits, -first - start) < (best[0], -best[1]):
            best = (edits, first + start, first + end)
    return best


def leaks_of(
    words: np.ndarray,
    items: Items,
    held: tuple[np.ndarray, ...] | None = None,
    alone: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[tuple[int, int, int, int, int]]:
    """``(item, edits, item words, start, end)`` of the items that a text leaks; best passage."""
    if not len(words) or not len(items.ids):
        return []
    place, owner, pair = held_pairs(pairs_of(words), items) if held is None else held
    lengths = items.lengths
    counts = np.bincount(owner, minlength=len(lengths))
    needed = np.maximum(1, lengths - 1 - 2 * (EDITS * lengths).astype(int))
    tried: set[tuple[int, int, int]] = set()
    best: dict[int, tuple[int, int, int, int, int]] = {}
    at, single = held_words(words, items) if alone is None else alone
    single, first = np.unique(single, return_index=True)
    for item, start in zip(single.tolist(), at[first].tolist(), strict=True):
        best[item] = (item, 0, 1, start, start + 1)
    for likely in np.flatnonzero(counts >= needed).tolist():
        length = int(lengths[likely])
        mine = owner == likely
        for low, high in places(place[mine], pair[mine], length, int(items.distinct[likely])):
            low, high = max(0, low), min(len(words), high)
            for item in {likely, *window_items(words, low, high, length, items)}:
                if (item, low, high) in tried:
                    continue
                tried.add((item, low, high))
                edits, start, end = aligned(items.words[item], words[low:high])
                leak = (item, edits, int(lengths[item]), low + start, low + end)
                if edits <= allowed(int(lengths[item])) and (
                    item not in best or (edits, low + start) < (best[item][1], best[item][3])
                ):
                    best[item] = leak
    return [(int(items.ids[i]), *rest) for i, *rest in best.values()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked item of each document row: its best passage and the edits.

    Null and empty texts leak nothing, items without words are leaked by nothing, and a null
    item_id is not an item. Rows keep their doc_id, null included; repeated rows answer alike.
    Items with equal texts are leaked together. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )
    n = known.count()
    slices = max(1, -(-n // SLICE_ITEMS))
    out = None
    for k in range(slices):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).toArrow()
        part = part.sort_by("item_id")
        items = index_items(part.column("item_id").to_pylist(), part.column("text").to_pylist())
        shared = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in texts.chunks(batches):
                split = texts.split_words(pc.utf8_lower(batch.column("text")))
                hashes = split.hashes()
                pairs = pairs_of(hashes)
                # The last word of a text makes no pair with the first of the next one.
                last = split.first[1:-1]
                pairs[last[(last > 0) & (last <= len(pairs))] - 1] = 0
                place, owner, pair = held_pairs(pairs, shared.value)
                bounds = np.searchsorted(place, split.first)
                at, single = held_words(hashes, shared.value)
                single_bounds = np.searchsorted(at, split.first)
                ids, rows = batch.column("doc_id").to_pylist(), []
                for row in np.flatnonzero((np.diff(bounds) > 0) | (np.diff(single_bounds) > 0)):
                    a, b = split.first[row], split.first[row + 1]
                    part = slice(bounds[row], bounds[row + 1])
                    held = (place[part] - a, owner[part], pair[part])
                    part = slice(single_bounds[row], single_bounds[row + 1])
                    alone = (at[part] - a, single[part])
                    rows += [(ids[row], *leak) for leak in leaks_of(hashes[a:b], shared.value, held, alone)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    names = [x.split()[0] for x in LEAKS.split(", ")]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all columns, without the documents that leak an item."""
    found = leaks(docs, benchmark).where(F.col("doc_id").isNotNull())
    ids = materialize(found.select("doc_id").distinct(), "leaking")
    return tables.join_by_id(docs, ids, "doc_id", "left_anti")

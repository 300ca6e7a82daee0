"""Repeated byte strings: Burrows-Wheeler transforms of shards, merged by interleave refinement.

Texts that hold no repeated string of ``WINDOW`` bytes are ruled out by minimisers; what may
repeat goes to buckets as distinct strings with their first occurrence. In a bucket two shards
are transformed and merged (see ``bwt``); rows that share ``WINDOW`` symbols form the repeated
intervals. Every occurrence but the first of an interval covers bytes to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import bwt, superkmers, tables, texts
from tagloom.shared import materialize

WINDOW = 100
# With 60 places for a gram in a window, an ordinary super-k-mer is not cut at MOST_WINDOWS.
GRAM = 41
KIND = superkmers.Kind(WINDOW, GRAM, superkmers.byte_units)
LAST = (1 << 63) - 1
# Text that is transformed at once: the arrays of so many symbols stay in a core's cache.
PIECE_BYTES = 1 << 15


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct string with its first occurrence and the windows that start earlier in another string."""
    for table, bounds in tables.whole_groups(batches, ["minimiser"], 1 << 11):
        sizes = np.diff(bounds)
        # A string that is alone in its bucket repeats nothing but itself.
        twice = table.column("twice").to_numpy() > 0
        rows = np.flatnonzero(np.repeat(sizes > 1, sizes) | twice)
        mask = np.zeros(table.num_rows, np.int64)
        for piece in _pieces(table, rows, np.repeat(np.arange(len(sizes)), sizes)):
            mask[piece] = _earlier_masks(table.take(pa.array(piece)))
        kept = ["minimiser", "string_id", "first_doc", "first_start"]
        columns = [table.column(c).combine_chunks() for c in kept]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(mask)], names=[*kept, "mask"])


def _pieces(table: pa.Table, rows: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """``rows`` in pieces of whole groups, of at most ``PIECE_BYTES`` of text if a group has no more."""
    if not len(rows):
        return
    group = group[rows]
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(rows))
    lengths = pc.binary_length(table.column("packed")).to_numpy()[rows]
    size = np.cumsum(lengths + 1)[ends - 1]
    at, start, base = 0, 0, 0
    while at < len(ends):
        at = max(at + 1, int(np.searchsorted(size, base + PIECE_BYTES, side="right")))
        yield rows[start : ends[at - 1]]
        start, base = ends[at - 1], size[at - 1]


def _earlier_masks(table: pa.Table) -> np.ndarray:
    packed = table.column("packed").to_pylist()
    doc, start = (table.column(c).to_numpy() for c in ("first_doc", "first_start"))
    string, offset, block = bwt.window_classes(packed, WINDOW)
    mask = np.zeros(len(packed), np.int64)
    new = np.ones(len(block) + 1, bool)
    new[1:-1] = block[1:] != block[:-1]
    # Most windows are alone in their class.
    shared = np.flatnonzero(~(new[:-1] & new[1:]))
    if not len(shared):
        return mask
    string, offset, new = string[shared], offset[shared], new[shared]
    own, at, begin, of = doc[string], start[string] + offset, np.flatnonzero(new), np.cumsum(new) - 1
    later = own > np.minimum.reduceat(own, begin)[of]
    first = np.minimum.reduceat(np.where(later, LAST, at), begin)[of]
    later |= at > first
    np.bitwise_or.at(mask, string[later], np.int64(1) << offset[later])
    return mask


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.chunks(batches, "packed"):
        data, offsets = texts.utf8(batch.column("packed"))
        half = texts.byte_runs_hashes(data, WINDOW // 2)
        n = np.diff(offsets) - WINDOW + 1
        row = np.repeat(np.arange(batch.num_rows), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[row] + place
        start = batch.column("first_start").to_numpy()[row] + place
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c).take(pa.array(row)) for c in ("minimiser", "string_id", "first_doc")],
                pa.array(start, pa.int64()),
                pa.array(place, pa.int32()),
                pa.array(half[at].view(np.int64)),
                pa.array(half[at + WINDOW // 2].view(np.int64)),
            ],
            names=["minimiser", "string_id", "first_doc", "first_start", "place", "w1", "w2"],
        )


def _hot_masks(strings: DataFrame) -> DataFrame:
    """The masks of strings with hot minimisers: windows combined by name before the exchange."""
    schema = (
        "minimiser long, string_id long, first_doc long, first_start long, place int, w1 long, w2 long"
    )
    rows = strings.select("minimiser", "string_id", "first_doc", "first_start", "packed")
    windows = materialize(rows.mapInArrow(_name, schema), "hot-windows")
    here = F.struct("first_doc", "first_start")
    least = windows.groupBy("w1", "w2").agg(F.min(here).alias("least"))
    return superkmers.masks_of(windows.join(least, ["w1", "w2"]).where(here > F.col("least")))


def removed_runs(n: int, starts: np.ndarray, masks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the masks' windows cover."""
    gone = superkmers.window_cover(n, starts, masks, WINDOW).astype(np.int8)
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
    return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.chunks(batches):
        data, offsets = texts.utf8(batch.column("text"))
        ends, starts, masks = superkmers.found_masks(batch)
        removed, spans, digests = [], [], []
        for row in range(batch.num_rows):
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            own = slice(ends[row], ends[row + 1])
            runs = removed_runs(len(text), starts[own], masks[own])
            removed.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            kept = zip([0, *[b for _, b in runs]], [*[a for a, _ in runs], len(text)], strict=True)
            digests.append(_sha(b"".join(text[a:b] for a, b in kept)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("k1"), batch.column("k2"),
                pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests),
            ],
            names=["k1", "k2", "n_removed", "n_spans", "kept_sha256"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs(doc_id, text)``.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller doc_id, or before
    it in the same document. A null doc_id comes last. Null and empty texts have no bytes. Rows
    that share doc_id and text are one document and answer alike. Other columns are ignored.
    """
    keyed = superkmers.with_keys(docs)
    scanned = superkmers.scan(keyed, KIND, _sha)
    runs = superkmers.emitted(keyed, scanned, KIND).select(
        "minimiser", "packed", "string_id", "k1", "k2", "start", "windows", "twice",
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"),
    )
    first = F.min(F.struct("doc", "start"))
    cool, hot = (
        part.groupBy("minimiser", "packed")
        .agg(
            first.alias("first"),
            F.first("string_id").alias("string_id"),
            F.max("twice").alias("twice"),
        )
        .select(
            "minimiser", "packed", "string_id", "twice",
            F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"),
        )
        for part in superkmers.split_hot(runs)
    )
    schema = "minimiser long, string_id long, first_doc long, first_start long, mask long"
    earlier = tables.sorted_by(cool, ["minimiser"], ["string_id"]).mapInArrow(_earlier, schema)
    hot = materialize(hot, "hot-strings", "zstd")
    cut_up = hot.drop("packed", "twice").join(_hot_masks(hot), ["minimiser", "string_id"], "left")
    known = materialize(earlier.unionByName(cut_up), "earlier-windows")
    full = F.expr("shiftleft(1L, cast(windows AS int)) - 1")
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    later = runs.select("minimiser", "string_id", "k1", "k2", "doc", "start", "windows").join(
        known, ["minimiser", "string_id"]
    )
    later = later.select(
        "k1", "k2", "start", F.when(is_first, F.coalesce("mask", F.lit(0))).otherwise(full).alias("mask")
    ).where(F.col("mask") != 0)
    found = later.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "mask")).alias("found"))
    hit = superkmers.restricted(keyed, materialize(found, "later-windows"))
    cut = (
        hit.select("text", "k1", "k2", "found")
        .mapInArrow(_cut, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string")
        .dropDuplicates(["k1", "k2"])
    )
    return scanned.drop("minimisers", "times").join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n_units").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )

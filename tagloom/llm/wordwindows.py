"""Repeated windows of words: super-k-mers go to the bucket of their minimiser, are sorted and counted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import superkmers, tables, texts
from tagloom.shared import materialize

WINDOW = 35
GRAM = 8
KIND = superkmers.Kind(WINDOW, GRAM, superkmers.word_units)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def window_names(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of all windows of packed strings, and the string each belongs to."""
    words = texts.split_words(packed.cast(pa.string()))
    hashes = words.hashes()
    names = np.stack([texts.runs_hashes(hashes, WINDOW, seed) for seed in (51, 52)], axis=1)
    rows = words.rows
    inside = rows[: len(names)] == rows[WINDOW - 1 :] if len(names) else np.zeros(0, bool)
    return names[inside], rows[: len(names)][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mask of repeated windows for every distinct string; buckets stand together, sorted."""
    for table, _ in tables.whole_groups(batches, ["minimiser"], 1 << 12):
        names, row = window_names(table.column("packed").combine_chunks())
        copies = table.column("copies").to_numpy()
        order = np.lexsort((names[:, 1], names[:, 0]))
        ordered = names[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        at = np.cumsum(new) - 1
        total = np.bincount(at, copies[row[order]])
        repeated = np.zeros(len(order), bool)
        repeated[order] = total[at] > 1
        first = np.searchsorted(row, np.arange(table.num_rows))
        place = np.arange(len(row)) - first[row]
        mask = np.zeros(table.num_rows, np.int64)
        np.bitwise_or.at(mask, row[repeated], np.int64(1) << place[repeated])
        hit = np.flatnonzero(mask)
        for batch in table.select(["minimiser", "string_id"]).take(pa.array(hit)).to_batches():
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(mask[hit][: batch.num_rows])],
                names=["minimiser", "string_id", "mask"],
            )
            hit = hit[batch.num_rows :]


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.chunks(batches, "packed"):
        names, row = window_names(batch.column("packed"))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c).take(at) for c in ("minimiser", "string_id", "copies")],
                pa.array(place, pa.int32()),
                *[pa.array(names[:, k].view(np.int64)) for k in (0, 1)],
            ],
            names=["minimiser", "string_id", "copies", "place", "w1", "w2"],
        )


def _hot_masks(strings: DataFrame) -> DataFrame:
    """The masks of strings with hot minimisers: windows combined by name before the exchange."""
    schema = "minimiser long, string_id long, copies long, place int, w1 long, w2 long"
    windows = materialize(strings.mapInArrow(_name, schema), "hot-windows")
    total = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where(F.col("n") > 1)
    return superkmers.masks_of(windows.join(total, ["w1", "w2"]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.chunks(batches):
        words = texts.split_words(batch.column("text"))
        ends, starts, masks = superkmers.found_masks(batch)
        removed, digests = [], []
        for row in range(batch.num_rows):
            a, b = int(words.first[row]), int(words.first[row + 1])
            own = slice(ends[row], ends[row + 1])
            gone = superkmers.window_cover(b - a, starts[own], masks[own], WINDOW)
            removed.append(int(gone.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
            kept = [words.joined(a + int(x), a + int(y)) for x, y in zip(edges[::2], edges[1::2], strict=True)]
            digests.append(_sha(b" ".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(digests)],
            names=["k1", "k2", "n_removed", "kept_sha256"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row of ``docs(doc_id, text)``.

    A word goes if a 35-word window over it starts anywhere else too, in the input. Null and
    empty texts have no words, shorter texts no window. Rows are documents of their own, also
    those with a null or repeated doc_id: equal rows remove each other. Other columns are ignored.
    """
    keyed = superkmers.with_keys(docs)
    scanned = superkmers.scan(keyed, KIND, _sha)
    runs = superkmers.emitted(keyed, scanned, KIND)
    cool, hot = (
        part.groupBy("minimiser", "packed").agg(
            F.count(F.lit(1)).alias("copies"), F.first("string_id").alias("string_id")
        )
        for part in superkmers.split_hot(runs)
    )
    counted = tables.sorted_by(cool, ["minimiser"]).mapInArrow(
        _count, "minimiser long, string_id long, mask long"
    )
    masks = materialize(counted.unionByName(_hot_masks(hot)), "window-masks")
    found = (
        runs.select("minimiser", "string_id", "k1", "k2", "start")
        .join(masks, ["minimiser", "string_id"])
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "mask")).alias("found"))
    )
    hit = superkmers.restricted(keyed, materialize(found, "repeated-windows"))
    cut = (
        hit.select("text", "k1", "k2", "found")
        .mapInArrow(_cut, "k1 long, k2 long, n_removed long, kept_sha256 string")
        .dropDuplicates(["k1", "k2"])
    )
    return scanned.drop("minimisers", "times").join(cut, ["k1", "k2"], "left").select(
        "doc_id",
        F.col("n_units").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )

"""Super-k-mers: consecutive windows of a text that share a minimiser, as one packed string.

A window is ``window`` consecutive units (words or bytes); its minimiser is the least hash of the
``gram``-unit runs in it, so equal windows have equal minimisers. Only minimisers of two or more
super-k-mers can belong to a repeated window. They are counted first, and only super-k-mers
with such a minimiser travel to their bucket, equal ones combined before the exchange. A minimiser of
very many different super-k-mers would make a hot bucket: these are cut into windows, which are
combined by name instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import tables, texts
from tagloom.shared import materialize

# Different super-k-mers of one minimiser beyond which they are cut into windows.
HOT = 2_000
# Bits that name a minimiser: two that share a name only share a bucket, and shorter names pack better.
NAME_BITS = np.uint64(40)
# Windows of a super-k-mer at most: one bit each in a 64-bit mask.
MOST_WINDOWS = 60
# Runs whose bytes are gathered at once.
PACKED_RUNS = 1 << 12


@dataclass(frozen=True)
class Units:
    """The units of a chunk: bounds of each row in units, gram hashes, and how to pack runs."""

    first: np.ndarray
    grams: np.ndarray
    pack: Callable[[np.ndarray, np.ndarray], pa.Array]
    whole: Callable[[int], bytes]


@dataclass(frozen=True)
class Kind:
    window: int
    gram: int
    split: Callable[[pa.Array, int], Units]


def word_units(column: pa.Array, gram: int) -> Units:
    words = texts.split_words(column)
    grams = texts.runs_hashes(words.hashes(), gram, 41)
    return Units(
        words.first,
        grams,
        lambda a, b: pa.array([words.joined(*ab) for ab in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
        lambda row: words.joined(int(words.first[row]), int(words.first[row + 1])),
    )


def byte_units(column: pa.Array, gram: int) -> Units:
    data, offsets = texts.utf8(column)
    return Units(
        offsets,
        texts.byte_runs_hashes(data, gram),
        lambda a, b: byte_runs(data, a, b),
        lambda row: data[offsets[row] : offsets[row + 1]].tobytes(),
    )


def byte_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each of ``begin`` up to ``end``."""
    bounds = np.concatenate([[0], np.cumsum(end - begin)])
    out = np.empty(bounds[-1], np.uint8)
    for at in range(0, len(begin), PACKED_RUNS):
        n = (end - begin)[at : at + PACKED_RUNS]
        low, high = bounds[at], bounds[at + len(n)]
        from_place = np.arange(low, high) + np.repeat(begin[at : at + len(n)] - bounds[at : at + len(n)], n)
        out[low:high] = data.take(from_place)
    buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)]
    return pa.Array.from_buffers(pa.binary(), len(begin), buffers)


def runs_of(units: Units, kind: Kind, row: int) -> tuple[np.ndarray, ...]:
    """``(minimiser, first window, windows, twice)`` of a row's super-k-mers.

    Windows count from 0. ``twice``: the minimiser stands at two places of the super-k-mer, which
    may then hold a window twice by itself.
    """
    a, b = int(units.first[row]), int(units.first[row + 1])
    n = b - a - kind.window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none.astype(bool)
    grams, width = units.grams[a : b - kind.gram + 1], kind.window - kind.gram + 1
    bits = np.uint64(max(20, int(len(grams)).bit_length()))
    place = np.arange(len(grams), dtype=np.uint64)
    high, low = grams >> bits << bits, (np.uint64(1) << bits) - np.uint64(1)
    left = texts.sliding_minimum(high | place, width) & low
    right = low - (texts.sliding_minimum(high | (low - place), width) & low)
    least = grams[left.astype(np.int64)]
    names = least >> (np.uint64(64) - NAME_BITS)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    lengths = np.diff(np.concatenate([starts, [n]]))
    twice = left[starts] != right[starts + lengths - 1]
    if lengths.max() > MOST_WINDOWS:
        pieces = -(-lengths // MOST_WINDOWS)
        index = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + index * MOST_WINDOWS
        twice = np.repeat(twice, pieces)
        lengths = np.diff(np.concatenate([starts, [n]]))
    return names[starts], starts, lengths, twice


def with_keys(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, k1, k2)``: the keys name a row by its id and text, nulls included."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"),
        F.xxhash64("doc_id", "text").alias("k2"),
    )


def scan(keyed: DataFrame, kind: Kind, digest: Callable[[bytes], str]) -> DataFrame:
    """Size, digest, and distinct minimisers with their super-k-mers of every document row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches):
            units = kind.split(batch.column("text"), kind.gram)
            runs = [runs_of(units, kind, row) for row in range(batch.num_rows)]
            # One that may hold a window twice counts twice.
            found = [np.unique(np.concatenate([r[0], r[0][r[3]]]), return_counts=True) for r in runs]
            ends = np.cumsum([0, *[len(f) for f, _ in found]])
            flat = np.concatenate([np.zeros(0, np.uint64), *[f for f, _ in found]]).view(np.int64)
            times = np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "k1", "k2")],
                    pa.array(np.diff(units.first).astype(np.int64)),
                    pa.array([digest(units.whole(row)) for row in range(batch.num_rows)], pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32())),
                ],
                names=["doc_id", "k1", "k2", "n_units", "whole_sha256", "minimisers", "times"],
            )

    schema = (
        "doc_id long, k1 long, k2 long, n_units long, whole_sha256 string, "
        "minimisers array<long>, times array<int>"
    )
    return materialize(keyed.mapInArrow(read, schema), "scanned", "zstd")


def restricted(keyed: DataFrame, per_row: DataFrame) -> DataFrame:
    """The rows of ``keyed`` with a partner in ``per_row``, joined with it.

    Rows without a partner are dropped before the exchange where the keys fit a broadcast.
    """
    keys = per_row.select("k1", "k2")
    if keys.count() * tables.ID_ROW_BYTES <= tables.BROADCAST_BYTES:
        keyed = keyed.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    return keyed.join(per_row, ["k1", "k2"])


def emitted(keyed: DataFrame, scanned: DataFrame, kind: Kind) -> DataFrame:
    """All super-k-mers whose minimiser occurs again: where they start, their windows and text."""
    posted = scanned.select("k1", "k2", F.inline(F.arrays_zip("minimisers", "times")).alias("minimiser", "times"))
    counts = posted.groupBy("minimiser").agg(F.sum("times").alias("n")).where(F.col("n") > 1)
    # Equal rows post alike; the sets below take them once.
    shared = posted.select("k1", "k2", "minimiser").join(counts.select("minimiser"), "minimiser")
    per_row = materialize(
        shared.groupBy("k1", "k2").agg(F.collect_set("minimiser").alias("repeated")),
        "repeated-minimisers",
        "zstd",
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches, limit=1 << 19):
            units = kind.split(batch.column("text"), kind.gram)
            ends = np.cumsum(np.concatenate([[0], batch.column("repeated").value_lengths().to_numpy()]))
            flat = batch.column("repeated").flatten().to_numpy().view(np.uint64)
            found = []
            for row in range(batch.num_rows):
                least, starts, lengths, twice = runs_of(units, kind, row)
                repeated = np.sort(flat[ends[row] : ends[row + 1]])
                if len(repeated):
                    at = np.minimum(np.searchsorted(repeated, least), len(repeated) - 1)
                    hit = np.flatnonzero(repeated[at] == least)
                    found.append((np.full(len(hit), row), least[hit], starts[hit], lengths[hit], twice[hit]))
            if found:
                row, least, starts, lengths, twice = (np.concatenate(x) for x in zip(*found, strict=True))
                begin = units.first[row] + starts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least.view(np.int64)),
                        *[batch.column(c).take(pa.array(row)) for c in ("k1", "k2", "doc_id")],
                        *[pa.array(x.astype(np.int64)) for x in (starts, lengths, twice)],
                        units.pack(begin, begin + lengths + kind.window - 1),
                    ],
                    names=["minimiser", "k1", "k2", "doc_id", "start", "windows", "twice", "packed"],
                )

    schema = (
        "minimiser long, k1 long, k2 long, doc_id long, start long, windows long, "
        "twice long, packed binary"
    )
    packed = restricted(keyed, per_row).select("text", "k1", "k2", "doc_id", "repeated")
    out = packed.mapInArrow(pack, schema).withColumn("string_id", F.xxhash64("packed"))
    # Neighbours overlap, which the stronger compression finds.
    return materialize(out, "super-k-mers", "zstd")


def split_hot(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Super-k-mers of minimisers with at most ``HOT`` different ones, and the others."""
    different = runs.select("minimiser", "string_id").distinct().groupBy("minimiser").count()
    hot = materialize(different.where(F.col("count") > HOT).select("minimiser"), "hot-minimisers")
    return (
        tables.join_by_id(runs, hot, "minimiser", "left_anti"),
        tables.join_by_id(runs, hot, "minimiser", "left_semi"),
    )


def masks_of(windows: DataFrame) -> DataFrame:
    """``(minimiser, string_id, mask)`` from rows that name single windows by ``place``."""
    bit = F.expr("shiftleft(1L, place)")
    return windows.groupBy("minimiser", "string_id").agg(F.bit_or(bit).alias("mask"))


def window_cover(n: int, starts: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` units lie in a window: window ``starts[i] + j`` for every bit j of ``masks[i]``."""
    which, place = np.nonzero(masks[:, None] >> np.arange(MOST_WINDOWS) & 1)
    at = starts[which] + place
    edges = np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def found_masks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, starts and masks of the ``found`` column's lists."""
    column = batch.column("found")
    values = column.flatten()
    ends = np.cumsum(np.concatenate([[0], column.value_lengths().to_numpy()]))
    return ends, values.field("start").to_numpy(), values.field("mask").to_numpy()

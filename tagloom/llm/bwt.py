"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

The strings of a shard, each ended by a terminator, form one cyclic text. Its rows are the
rotations in order. Two shards are merged without sorting suffixes again: an interleave says
which shard each merged row comes from; taking the symbols before each row in interleave order
and dealing the rows stably by them gives the interleave that is right for so many symbols more. A
round takes ``STEP`` symbols, as the rank of their run among those of both shards. Rows
that still agree after k rounds share a prefix of k runs: the rounds also yield common prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shard:
    """Rotations in order as text positions, and the symbols before each: ``STEP`` of them, a byte each."""

    order: np.ndarray
    before: np.ndarray


# Symbols of a round: as many as one number holds.
STEP = 8


def encode(strings: list[bytes]) -> np.ndarray:
    """One text of symbols: bytes in dense order from 1, a 0 behind each string."""
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    # The bytes C0, C1 and F5 to FF never occur.
    text = data.astype(np.uint16) + 1 - 2 * (data > 0xC1).astype(np.uint16)
    text[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
    return text


def build(text: np.ndarray, depth: int) -> Shard:
    """Rotations ordered by at least their first ``depth`` symbols, by prefix doubling."""
    n = len(text)
    key, have = text.astype(np.uint64), 1
    while have < STEP:
        key = key << np.uint64(8 * have) | np.roll(key, -have)
        have *= 2
    run = key
    while True:
        # Rows that tie share a rank, in whatever order they stand.
        order = places(key)
        if have >= depth:
            return Shard(order, run.take(order - STEP, mode="wrap"))
        rank = ranks_in(key, order)
        if rank[order[-1]] == n - 1:
            return Shard(order, run.take(order - STEP, mode="wrap"))
        key = rank * n + np.roll(rank, -have)
        have *= 2


def places(values: np.ndarray) -> np.ndarray:
    """Places in the stable order of numbers that are not negative."""
    bits, most = max(1, len(values) - 1).bit_length(), int(values.max(initial=0)).bit_length()
    if bits + most > 64:
        return np.argsort(values, kind="stable")
    # Number and place in one, the smaller the faster, sort faster than places by numbers.
    kind = np.uint32 if bits + most <= 32 else np.uint64
    both = values.astype(kind) << kind(bits)
    both |= np.arange(len(values), dtype=kind)
    both.sort()
    both &= kind((1 << bits) - 1)
    return both.astype(np.int64)


def ranks_in(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each value among the distinct ones, by their order."""
    ordered = values.take(order)
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([np.zeros(min(1, len(values)), bool), ordered[1:] != ordered[:-1]]))
    return out


def ranks(values: np.ndarray) -> np.ndarray:
    """Place of each value among the distinct ones."""
    return ranks_in(values, places(values))


def dealt_by(rank: np.ndarray) -> np.ndarray:
    """The stable order of ranks."""
    return places(rank)


def merge(a: Shard, b: Shard, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(from_b, block)`` of the merged rows: the interleave, and equal numbers for rows that
    share their first ``depth`` symbols."""
    split = len(a.order)
    n = split + len(b.order)
    number = np.int32 if n < 1 << 30 else np.int64
    before = np.concatenate([a.before, b.before])
    whole = ranks(before).astype(number)
    # Where whole runs don't make up the depth, the first round takes a shorter one: the last symbols.
    rest = depth % STEP
    rounds = [whole] * (depth // STEP)
    if rest:
        rounds.insert(0, ranks(before & np.uint64((1 << 8 * rest) - 1)).astype(number))
    # A row's block and, as the last bit, its shard.
    row = (np.arange(n) >= split).astype(number)
    of, new = np.empty(n, number), np.zeros(n, bool)
    for runs in rounds:
        from_b = (row & 1).astype(bool)
        of[np.flatnonzero(from_b)], of[np.flatnonzero(~from_b)] = runs[split:], runs[:split]
        dealt = dealt_by(of)
        row, run = row.take(dealt), of.take(dealt)
        old = row >> 1
        np.logical_or(run[1:] != run[:-1], old[1:] != old[:-1], out=new[1:])
        row &= 1
        row += 2 * np.cumsum(new, dtype=number)
    return (row & 1).astype(bool), (row >> 1).astype(np.int64)


def window_classes(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(string, offset, class)`` of all windows; equal windows have equal classes.

    The strings are dealt to two shards whose transforms are merged.
    """
    half = (len(strings) + 1) // 2
    parts = [strings[:half], strings[half:]]
    texts = [encode(part) for part in parts if part]
    shards = [build(text, window) for text in texts]
    owner = np.concatenate([np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])])
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    if len(shards) == 1:
        shards.append(Shard(np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    from_b, block = merge(*shards, window)
    position = np.empty(len(from_b), np.int64)
    position[~from_b] = shards[0].order
    position[from_b] = shards[1].order + len(shards[0].order)
    string = owner[position]
    offset = position - starts[string]
    inside = offset + window <= starts[string + 1] - starts[string] - 1
    return string[inside], offset[inside], block[inside]

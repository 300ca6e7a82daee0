"""Product codes of vectors: a lexicographic trie over distinct parts shares their distances.

Components become integers, a vector is cut into equal parts, and every part is replaced by the
index of its nearest codebook entry. The distinct parts are written once, sorted, with their counts.
In each round a task reads a sorted run of them as a trie: it walks depth first and adds the squared
differences of a common prefix to *all* entries once for everything below it; at the leaves the
nearest entry is the smallest index of the least distance, and parts are summed by entry, weighted by
how often they occur. Only these sums leave a task: the driver holds codebooks, never vectors.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped. A vector
whose length differs from that of the first codebook vector keeps its row with a NULL code and error. A
length that no equal parts fit is cut at ``length * i // parts``. Repeated ids are answered each; of the
smallest ids NULL comes last, equal ones by their components. Errors beyond a long stay at its maximum.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.tables import join_hot
from tagloom.shared import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Leaves whose remaining dimensions are finished by one matrix product.
LEAVES = 4096
# Below this, sums of squares are exact in double precision.
EXACT = 2.0**53
LONG_MAX = (1 << 63) - 1
# Bits of a sum that travel in one long.
LIMB_BITS = 40


@dataclass(frozen=True)
class Layout:
    """How components are stored: order-preserving bytes of ``width``, parts cut at ``cuts``."""

    width: int
    cuts: tuple[int, ...]

    def packed(self, values: np.ndarray) -> np.ndarray:
        """Rows of integers (as doubles) as byte rows that sort as the integers do."""
        if self.width == 8:
            bits = (values + 0.0).view(np.uint64)
            raised = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)).astype(">u8")
        else:
            half = 1 << (8 * self.width - 1)
            raised = (values.astype(np.int64) + half).astype(f">u{self.width}")
        return np.ascontiguousarray(raised).view(np.uint8).reshape(len(values), self.width * values.shape[1])

    def unpacked(self, data: np.ndarray) -> np.ndarray:
        """Integers as doubles from byte rows."""
        raised = np.ascontiguousarray(data).view(f">u{self.width}")
        if self.width == 8:
            bits = raised.astype(np.uint64)
            top = bits >> np.uint64(63)
            return np.where(top, bits ^ np.uint64(1 << 63), ~bits).view(np.float64)
        return (raised.astype(np.int64) - (1 << (8 * self.width - 1))).astype(np.float64)


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of every usable vector."""
    values = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad).select(
        F.col(id_col), F.col(label_col).alias("label"), values.alias("vector")
    )
    first = _smallest(usable, id_col, entries)
    if not first:
        return _empty(usable, id_col)
    length = len(first[0])
    first = [v for v in first if len(v) == length]
    equal = F.size("vector") == length
    layout = Layout(_width(usable.where(equal)), tuple(length * i // parts for i in range(parts + 1)))
    start = scaled(np.array(first, np.float64))
    codebooks = [start[:, a:b] for a, b in zip(layout.cuts, layout.cuts[1:])]
    distinct = _distinct_parts(usable.where(equal), layout)
    for _ in range(rounds):
        codebooks = _moved(distinct, codebooks, layout)
    coded = materialize(_coded(usable, id_col, codebooks, layout), "codes")
    sums = coded.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)"))
        .cast("long")
        .alias("label_error")
    )
    return join_hot(coded, sums, "label").select(
        id_col, "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )


def scaled(values: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` as doubles; beyond the range of doubles the largest one."""
    top = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -top, top)


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position."""
    numbers = (str(int(x)) for book in codebooks for entry in book for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, squared distance)`` of the entry nearest to each row, the lower index among equals.

    ``rows`` are distinct and in lexicographic order. The walk goes depth first over their trie with a
    stack of nodes ``(first row, end row, depth, distances of all entries over the prefix)``; rows
    that stand alone below a node wait with its distances until there are enough for one product.
    """
    n, d = rows.shape
    largest = max(np.abs(rows).max(initial=0.0), np.abs(entries).max(initial=0.0))
    if not 4.0 * max(d, 1) * largest * largest < EXACT:
        rows, entries = (_python_integers(x) for x in (rows, entries))
    index = np.zeros(n, np.int64)
    least = np.zeros(n, rows.dtype)
    # How many leading components a row shares with the one before it.
    same = rows[1:] == rows[:-1]
    shared = np.concatenate([[0], np.where(same.all(axis=1), d, np.argmin(same, axis=1)) if d else same[:, 0:0].sum(axis=1)])
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def finish(depth: int) -> None:
        groups = waiting.pop(depth)
        at = np.concatenate([g[0] for g in groups])
        known = np.repeat(np.stack([g[1] for g in groups]), [len(g[0]) for g in groups], axis=0)
        x, e = rows[at, depth:], entries[:, depth:]
        far = known + (x * x).sum(axis=1)[:, None] + (e * e).sum(axis=1)[None, :] - 2 * (x @ e.T)
        index[at] = np.argmin(far, axis=1)
        least[at] = far[np.arange(len(at)), index[at]]

    stack = [(0, n, 0, np.zeros(len(entries), rows.dtype))] if n else []
    while stack:
        lo, hi, depth, known = stack.pop()
        if hi - lo == 1:
            waiting.setdefault(depth, []).append((np.array([lo]), known))
            held += 1
            continue
        common = int(shared[lo + 1 : hi].min())
        if common > depth:
            gap = rows[lo, depth:common] - entries[:, depth:common]
            known = known + (gap * gap).sum(axis=1)
        edges = np.concatenate([[lo], lo + 1 + np.flatnonzero(shared[lo + 1 : hi] == common), [hi]])
        sizes = np.diff(edges)
        alone = edges[:-1][sizes == 1]
        if len(alone):
            waiting.setdefault(common, []).append((alone, known))
            held += len(alone)
        for k in np.flatnonzero(sizes > 1)[::-1]:
            stack.append((int(edges[k]), int(edges[k + 1]), common, known))
        if held >= LEAVES:
            for at in list(waiting):
                finish(at)
            held = 0
    for at in list(waiting):
        finish(at)
    return index, least


def _python_integers(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, object)
    out.flat = [int(x) for x in values.flat]
    return out


def _smallest(usable: DataFrame, id_col: str, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, in order.

    The best of every group of partitions are chosen first, so that the one last task reads some
    rows of each group and not of every partition.
    """
    order = [F.col(id_col).asc_nulls_last(), F.col("vector")]
    groups = int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = usable.select(id_col, "vector", (F.spark_partition_id() % groups).alias("_group"))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    best = dealt.withColumn("_rank", rank).where(F.col("_rank") <= entries)
    return [row.vector for row in best.orderBy(*order).limit(entries).select("vector").collect()]


def _width(usable: DataFrame) -> int:
    """Bytes a component takes: 2 or 4 as integers, 8 as a double."""
    high = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    largest = usable.agg(F.max(high).alias("m")).first().m or 0.0
    return 2 if largest * SCALE < 32000 else 4 if largest * SCALE < 2_000_000_000 else 8


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _distinct_parts(usable: DataFrame, layout: Layout) -> DataFrame:
    """``(part, packed, n)`` of all distinct parts, written in lexicographic runs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = scaled(_matrix(batch.column(0)))
            for part, (a, b) in enumerate(zip(layout.cuts, layout.cuts[1:])):
                rows, _, n = _sorted_parts(layout.packed(values[:, a:b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array([row.tobytes() for row in rows], pa.binary()),
                        pa.array(n.astype(np.int64)),
                    ],
                    ["part", "packed", "n"],
                )

    parts = usable.select("vector").mapInArrow(cut, "part int, packed binary, n long")
    counted = parts.groupBy("part", "packed").agg(F.sum("n").alias("n"))
    ordered = counted.repartitionByRange("part", "packed").sortWithinPartitions("part", "packed")
    return materialize(ordered, "parts")


def _sorted_parts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct byte rows in order, where each row went, and how many there were of each."""
    n, wide = packed.shape
    if not wide:
        return packed[: min(n, 1)], np.zeros(n, np.int64), np.array([n] if n else [], np.int64)
    keys = np.ascontiguousarray(packed).view(f"V{wide}").ravel()
    order = np.lexsort(packed.T[::-1])
    ordered = keys[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return packed[order[new]], place, np.diff(np.append(np.flatnonzero(new), n))


def _moved(distinct: DataFrame, codebooks: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """Codebooks whose used entries are the floored means of the parts nearest to them."""
    limbs = 2 if layout.width < 8 else 30

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            part_of = batch.column(0).to_numpy()
            weights = batch.column(2).to_numpy()
            for part in np.unique(part_of):
                at = part_of == part
                # A batch may hold the ends of several files: put them in order (most are).
                packed = _byte_rows(batch.column(1).filter(pa.array(at)))
                order = np.lexsort(packed.T[::-1]) if packed.shape[1] else np.arange(len(packed))
                rows = layout.unpacked(packed[order]) if packed.shape[1] else packed.astype(float)
                index, _ = nearest(rows, codebooks[part])
                for entry, n, sums in _weighted(rows, index, weights[at][order]):
                    kept = totals.setdefault((int(part), entry), [0, [0] * rows.shape[1]])
                    kept[0] += n
                    kept[1] = [a + b for a, b in zip(kept[1], sums)]
        if totals:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in totals], pa.int32()),
                    pa.array([k[1] for k in totals], pa.int32()),
                    pa.array([_limbs([n, *sums], limbs) for n, sums in totals.values()], pa.list_(pa.int64())),
                ],
                ["part", "entry", "sums"],
            )

    partial = distinct.mapInArrow(summed, "part int, entry int, sums array<long>")
    # Limbs add up on their own: as many rows as the codebooks have components, whatever the input.
    each = partial.select("part", "entry", F.posexplode("sums").alias("place", "value"))
    rows = each.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()
    sums: dict[tuple[int, int, int], int] = defaultdict(int)
    for row in rows:
        sums[row.part, row.entry, row.place // limbs] += row.value << (LIMB_BITS * (row.place % limbs))
    moved = [book.copy() for book in codebooks]
    for (part, entry, place), value in sums.items():
        if place:
            moved[part][entry, place - 1] = float(value // sums[part, entry, 0])
    return moved


def _limbs(values: list[int], limbs: int) -> list[int]:
    """Whole numbers of any size as ``limbs`` longs each, the lowest bits first, the sign in the last."""
    low = (1 << LIMB_BITS) - 1
    return [
        (x >> (LIMB_BITS * k)) & low if k < limbs - 1 else x >> (LIMB_BITS * k)
        for x in values
        for k in range(limbs)
    ]


def _byte_rows(column: pa.Array) -> np.ndarray:
    """The values of a binary column, all of one length, as a matrix."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    wide = int(at[1] - at[0]) if len(column) else 0
    if not wide:
        return np.zeros((len(column), 0), np.uint8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, wide)


def _weighted(
    rows: np.ndarray, index: np.ndarray, weights: np.ndarray
) -> Iterator[tuple[int, int, list[int]]]:
    """``(entry, count, weighted sums)`` of the entries that some row is nearest to."""
    order = np.argsort(index, kind="stable")
    firsts = np.flatnonzero(np.diff(index[order], prepend=-1))
    heaviest = float(np.abs(rows).max(initial=1.0)) * float(weights.sum())
    whole = rows.astype(np.int64) if heaviest < 2.0**62 else _python_integers(rows)
    whole = whole[order] * weights[order].astype(whole.dtype)[:, None]
    sums = np.add.reduceat(whole, firsts, axis=0) if rows.shape[1] else whole[firsts]
    counts = np.add.reduceat(weights[order], firsts)
    for k, at in enumerate(firsts):
        yield int(index[order[at]]), int(counts[k]), [int(x) for x in sums[k]]


def _coded(
    usable: DataFrame, id_col: str, codebooks: list[np.ndarray], layout: Layout
) -> DataFrame:
    """``(id, label, code, error)``: each batch assigns its own distinct parts; nothing is shuffled."""
    length = layout.cuts[-1]
    digits = max(2, len(f"{len(codebooks[0]) - 1:x}"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            fits = np.asarray(vectors.value_lengths()) == length
            values = scaled(_matrix(vectors.filter(pa.array(fits)))) if fits.any() else np.zeros((0, length))
            texts, errors = np.full(len(values), "", object), np.zeros(len(values), object)
            for book, a, b in zip(codebooks, layout.cuts, layout.cuts[1:]):
                rows, place, _ = _sorted_parts(layout.packed(values[:, a:b]))
                unpacked = layout.unpacked(rows) if b > a else np.zeros((len(rows), 0))
                index, least = nearest(unpacked, book)
                texts += np.array([f"{i:0{digits}x}" for i in index] or [""], object)[place]
                errors += np.array([int(x) for x in least] or [0], object)[place]
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            code[fits], error[fits] = texts, [min(x, LONG_MAX) for x in errors]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                [id_col, "label", "code", "error"],
            )

    kinds = dict(usable.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, label {kinds['label']}, code string, error long"
    return usable.select(id_col, "label", "vector").mapInArrow(coded, schema)


def _empty(usable: DataFrame, id_col: str) -> DataFrame:
    none: Callable[[str], Column] = lambda kind: F.lit(None).cast(kind)
    return usable.limit(0).select(
        id_col,
        none("string").alias("code"),
        none("long").alias("error"),
        none("long").alias("label_error"),
        none("string").alias("codebooks_sha256"),
    )

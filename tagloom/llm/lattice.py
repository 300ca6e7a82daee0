"""Near-duplicate vectors by lattice hashing.

Every table projects the unit vectors to eight random directions and decodes them to the nearest
point of the E8 lattice; a vector resides in its cell and visits the ``PROBES`` neighbouring cells
that it is nearest to. Residents are compared with residents and visitors of their cell by
the cosine in double precision. Equal vectors are one node; cells with many nodes are dealt into
pairs of blocks. A pair that meets in several cells counts in the one with the least name only,
and a task hands out sums and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import graph, tables, texts
from tagloom.shared import materialize

COSINE = 0.98
TABLES = 5
PROBES = 8
# Lattice spacing against the standard deviation of a projection of unit vectors.
SPACING = 1.2
BLOCK = 512
KEYS = TABLES * (1 + PROBES)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, twice their size: by sign and place."""
    whole = []
    for i in range(8):
        for j in range(i):
            for signs in ((2, 2), (2, -2), (-2, 2), (-2, -2)):
                vector = np.zeros(8, np.int64)
                vector[[j, i]] = signs
                whole.append(vector)
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    halves = (1 - 2 * bits)[bits.sum(axis=1) % 2 == 0]
    return np.concatenate([np.array(whole), halves])


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(y)
    rest = y - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    place = np.abs(rest[odd]).argmax(axis=1)
    point[odd, place] += np.where(rest[odd, place] >= 0, 1, -1)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points, twice their size as integers."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def cell_keys(unit: np.ndarray, space: np.ndarray) -> np.ndarray:
    """``(vector, KEYS)`` names of cells: in each table the own one, then those visited."""
    neighbours = minimal_vectors()
    factors = texts.constants(8, 61)
    out = np.zeros((len(unit), KEYS), np.uint64)
    for table in range(TABLES):
        directions = np.random.default_rng(1000 + table).standard_normal((unit.shape[1], 8))
        y = unit @ directions / SPACING
        own = decode(y)
        near = np.argsort(-((y - own / 2) @ neighbours.T), axis=1, kind="stable")[:, :PROBES]
        cells = np.concatenate([own[:, None, :], own[:, None, :] + neighbours[near]], axis=1)
        name = (cells.astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
        at = table * (1 + PROBES)
        out[:, at : at + 1 + PROBES] = texts.mix(name ^ space[:, None], 62 + table)
    return out


def units_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(column), -1)
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which all vectors have as many components."""
    sizes = batch.column("embedding").value_lengths().to_numpy()
    for size in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == size)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _by_length(whole) if whole.num_rows else ():
            space = texts.mix(batch.column("space").to_numpy().view(np.uint64), 60)
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = cell_keys(units_of(part.column("embedding")), space[start : start + 1024])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        pa.array([row.tobytes() for row in keys], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(keys) + 1) * KEYS, pa.int32()),
                            pa.array(keys.view(np.int64).ravel()),
                        ),
                    ],
                    names=["node", "key_bytes", "keys"],
                )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and for each the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, links)``: a node, the root it hangs from, and rows linked with it."""
    group = ["key", "block_a", "block_b"]
    for table, bounds in tables.whole_groups(batches, group, 1 << 12):
        node, size, role, side, key, block_a, block_b = (
            table.column(c).to_numpy()
            for c in ("node", "size", "role", "side", "key", "block_a", "block_b")
        )
        unit = units_of(table.column("embedding").combine_chunks()) if table.num_rows else None
        names = np.frombuffer(b"".join(table.column("key_bytes").to_pylist()), np.uint64)
        names = names.reshape(-1, KEYS)
        own = names[:, :: 1 + PROBES]
        xs, ys = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            one = block_a[a] == block_b[a]
            left = np.arange(a, b) if one else a + np.flatnonzero(side[a:b] == 0)
            right = left if one else a + np.flatnonzero(side[a:b] == 1)
            near = unit[left] @ unit[right].T >= COSINE
            near &= (role[left] == 0)[:, None] | (role[right] == 0)[None, :]
            x, y = np.nonzero(np.triu(near, 1) if one else near)
            x, y = left[x], right[y]
            name = key[a : a + 1].view(np.uint64)[0]
            for s in range(0, len(x), 4096):
                i, j = x[s : s + 4096], y[s : s + 4096]
                least = np.minimum(_least_common(own[i], names[j]), _least_common(own[j], names[i]))
                xs.append(i[least == name])
                ys.append(j[least == name])
        x, y = (np.concatenate([node[:0].astype(np.int64), *z]) for z in (xs, ys))
        if not len(x):
            continue
        nodes, root = _forest(node[x], node[y])
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, np.searchsorted(nodes, node[x]), size[y])
        np.add.at(links, np.searchsorted(nodes, node[y]), size[x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(root), pa.array(links)], names=["a", "b", "links"]
        )


def _least_common(own: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Least of each row of ``own`` that the same row of ``names`` holds; the largest number if none."""
    held = (own[:, :, None] == names[:, None, :]).any(axis=2)
    return np.where(held, own, np.uint64(2**64 - 1)).min(axis=1)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding, label)``.

    Vectors that are null, empty or zero or hold a null or non-finite component, and rows with a
    null label or vec_id, are linked with nothing. Vectors of other lengths are not
    compared. Rows with a repeated vec_id are vectors of their own. Other columns are ignored.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    usable = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite
        & F.exists(x, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        x.cast("array<double>").alias("embedding"),
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.xxhash64("label", F.size(x)).alias("space"),
    ).withColumn("node", F.xxhash64("space", "embedding"))
    rows = materialize(rows, "vectors")
    nodes = materialize(
        rows.where("usable").groupBy("node").agg(
            F.first("space").alias("space"), F.first("embedding").alias("embedding"),
            F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"),
        ),
        "vector-nodes",
    )
    keyed = materialize(
        nodes.select("node", "space", "embedding").mapInArrow(
            _keys, "node long, key_bytes binary, keys array<long>"
        ),
        "cells",
    )
    posted = keyed.select("node", F.posexplode("keys").alias("place", "key")).select(
        "node", "key", (F.col("place") % (1 + PROBES) > 0).cast("int").alias("role")
    )
    cells = posted.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("role").alias("least"))
    cells = cells.where((F.col("held") > 1) & (F.col("least") == 0)).select("key", "held")
    met = posted.join(cells, "key").join(
        nodes.select("node", "embedding", "size").join(keyed.select("node", "key_bytes"), "node"), "node"
    )
    blocks = tables.block_pairs(met, "held", F.xxhash64("node"), BLOCK)
    found = materialize(
        tables.sorted_by(blocks, ["key", "block_a", "block_b"]).mapInArrow(
            _compare, "a long, b long, links long"
        ),
        "vector-links",
    )
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = graph.components(found.select("a", "b"))
    placed = nodes.select("node", "size", "least").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = placed.join(named, "component").join(links, "node", "left").select(
        "node", "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    linked = rows.where("usable").select("vec_id", "node").join(answers, "node")
    alone = rows.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = linked.select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

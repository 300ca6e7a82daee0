"""MinHash near-duplicates by an inverted join on signature coordinates.

Every document posts itself under its coordinate-value pairs. Two signatures that agree in at
least ``MATCHES`` of ``COORDINATES`` places share one of their ``PREFIX`` first pairs in any
common order (prefix rule). The order puts pairs that many documents hold last, so their long
lists are skipped for all but the documents that consist of such pairs. Exact copies of a shingle
set are one node. In a few rounds every node meets the leading node it collides with most
often, which joins a group of copies by about one link each; then lists that still hold several
components are merged block by block. Pairs that agree in enough coordinates are confirmed on full sets:
the nodes of a block that have close partners in it form a cell, which gets every text once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import graph, tables, texts
from tagloom.shared import materialize

SHINGLE_WORDS = 5
COORDINATES = 64
# A pair of similarity 0.75 agrees in fewer places with a probability of 6e-6.
MATCHES = 32
PREFIX = COORDINATES - MATCHES + 1
# More coordinates, kept to 8 bits, narrow down the pairs that lists propose: of all 256, one
# pair of similarity 0.75 in about a million agrees in fewer places.
CHECKED = 192
MATCHES_OF_ALL = 160
# Rounds in which nodes meet leading nodes.
ROUNDS = 3
# A pair held by one in so many nodes is hot: at most COORDINATES * HOT_SHARE pairs are.
HOT_SHARE = 4096
HOT_LEAST = 32
# Rows of a list that are compared at once.
BLOCK = 256
# Shingles of either side of a cell, in which the sets of close nodes are compared.
CELL_SHINGLES = 1 << 21

SIGNATURES = "doc_id long, n_shingles long, set_key binary, signature binary"


def shingles(words: texts.Words, hashes: np.ndarray, row: int) -> np.ndarray:
    """The sorted hashes of a row's distinct shingles."""
    a, b = words.first[row], words.first[row + 1]
    if a == b:
        return np.zeros(0, np.uint64)
    return np.unique(texts.runs_hashes(hashes[a:b], min(SHINGLE_WORDS, b - a)))


def minhash(items: np.ndarray) -> bytes:
    """The smallest value of every hash function over all items; the checked ones cut to a byte."""
    n = COORDINATES + CHECKED
    factors = texts.constants(n, 11).astype(np.uint32)
    offsets = texts.constants(n, 12).astype(np.uint32)
    low = items.astype(np.uint32)
    least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(low), 256):
        part = low[start : start + 256, None] * factors + offsets
        np.minimum(least, part.min(axis=0), out=least)
    checked = (least[COORDINATES:] >> np.uint32(3)).astype(np.uint8)
    return least[:COORDINATES].tobytes() + checked.tobytes()


def values_of(signatures: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Posted and checked coordinates, one row per signature."""
    width = COORDINATES * 4 + CHECKED
    raw = np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, width)
    posted = np.ascontiguousarray(raw[:, : COORDINATES * 4]).view(np.uint32)
    return posted, raw[:, COORDINATES * 4 :]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.chunks(batches):
        words = texts.split_words(batch.column("text"), lower=True)
        hashes = words.hashes()
        sizes, keys, signatures = [], [], []
        for row in range(batch.num_rows):
            items = shingles(words, hashes, row)
            sizes.append(len(items))
            if len(items):
                sums = [texts.mix(items, seed).sum(dtype=np.uint64) for seed in (21, 22)]
                keys.append(np.array(sums, np.uint64).tobytes())
                signatures.append(minhash(items))
            else:
                keys.append(None)
                signatures.append(None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(signatures, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "set_key", "signature"],
        )


def pairs_of(posted: np.ndarray) -> np.ndarray:
    """64-bit names of the coordinate-value pairs."""
    place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    return texts.mix(posted.astype(np.uint64) | place, 31)


def held_by(pairs: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many nodes hold each pair, 0 for one that is not hot."""
    if not len(hot):
        return np.zeros(pairs.shape, np.int64)
    at = np.minimum(np.searchsorted(hot, pairs), len(hot) - 1)
    return np.where(hot[at] == pairs, counts[at], 0)


def prefix_pairs(posted: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The names at coordinates that belong to the prefix, 0 at the others."""
    pairs = pairs_of(posted)
    # Rarest first, among equals by name: one order for all documents.
    order = np.lexsort((pairs, held_by(pairs, hot, counts)), axis=1)[:, PREFIX:]
    np.put_along_axis(pairs, order, np.uint64(0), axis=1)
    return pairs


def naming_keys(pairs: np.ndarray, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of lists: the longest first, then by name; the last one for a pair of name 0."""
    top = np.int64((1 << 20) - 1)
    short = (top - np.minimum(held_by(pairs, hot, counts), top)).astype(np.uint64)
    keys = short << np.uint64(44) | pairs >> np.uint64(20)
    return np.where(pairs == 0, np.iinfo(np.uint64).max, keys)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            pair, n = np.unique(pairs_of(values_of(batch.column("signature"))[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"]
            )


def hot_pairs(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that many nodes hold, sorted, and their counts; bounded by HOT_SHARE."""
    least = max(HOT_LEAST, nodes.count() // HOT_SHARE)
    counts = nodes.select("signature").mapInArrow(_pair_counts, "pair long, n long")
    hot = counts.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    pair = hot.column("pair").to_numpy().view(np.uint64)
    order = np.argsort(pair)
    return pair[order], hot.column("n").to_numpy()[order]


def _postings(nodes: DataFrame, hot: Broadcast) -> DataFrame:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = prefix_pairs(values_of(batch.column("signature"))[0], *hot.value)
            row, place = np.nonzero(first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first[row, place].view(np.int64)),
                    pa.array(batch.column("node").to_numpy()[row]),
                ],
                names=["pair", "node"],
            )

    return nodes.select("node", "signature").mapInArrow(post, "pair long, node long")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (values_of(batch.column(c)) for c in ("signature_a", "signature_b"))
            equal = sum((x == y).sum(axis=1) for x, y in zip(a, b, strict=True))
            yield batch.select(["a", "b"]).filter(pa.array(equal >= MATCHES_OF_ALL))


def agreeing(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures agree in ``MATCHES_OF_ALL`` places and whose sizes allow a link.

    Only these are worth two texts; blocks of lists are judged by the same places.
    """

    def side(name: str) -> DataFrame:
        return nodes.select(
            F.col("node").alias(name),
            F.col("n_shingles").alias(f"n_{name}"),
            F.col("signature").alias(f"signature_{name}"),
        )

    rows = candidates.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    fits = 100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b")
    close = rows.where(fits).select("a", "b", "signature_a", "signature_b")
    # Rows that share a doc_id may have several sets.
    return close.mapInArrow(_agree, "a long, b long").distinct()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, last_set = None, np.zeros(0, np.uint64)
    for whole in batches:
        for batch in texts.chunks(iter([whole]), "text_a"):
            names = batch.column("b").to_pylist()
            words = texts.split_words(batch.column("text_a"), lower=True)
            hashes = words.hashes()
            linked = []
            for row, name in enumerate(names):
                text = batch.column("text_b")[row]
                if (name, text) != last:
                    other = texts.split_words(pa.array([text.as_py()], pa.string()), lower=True)
                    last, last_set = (name, text), shingles(other, other.hashes(), 0)
                linked.append(similar(shingles(words, hashes, row), last_set))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def confirmed(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidate pairs ``(a, b)`` whose full shingle sets are similar enough."""
    candidates = materialize(candidates.select("a", "b"), "candidates")
    ids = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows = tables.join_by_id(docs.select("doc_id", "text"), ids, "doc_id")
    near = materialize(rows, "candidate-texts")
    with_a = candidates.join(near.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(near.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _colliding(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows that agree in at least MATCHES places."""
    if len(left) * len(right) <= 4096:
        equal = (left[:, None, :] == right[None, :, :]).sum(axis=2)
    else:
        equal = np.zeros((len(left), len(right)), np.uint8)
        for place in range(COORDINATES):
            equal += left[:, None, place] == right[None, :, place]
    return np.nonzero(equal >= MATCHES)


def _cells(
    name: tuple[int, ...], nodes: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray
) -> Iterator[tuple[np.int64, np.int64, np.ndarray]]:
    """The pairs of rows ``x``, ``y`` as ``(cell, node, partners)``, each node once in a cell.

    Cells are named after ``name`` and hold no more shingles of a side than ``CELL_SHINGLES``,
    or one node.
    """
    left, at_x = np.unique(x, return_inverse=True)
    right, at_y = np.unique(y, return_inverse=True)
    part_x = (np.cumsum(sizes[left]) // CELL_SHINGLES)[at_x]
    part_y = (np.cumsum(sizes[right]) // CELL_SHINGLES)[at_y]
    order = np.lexsort((y, x, part_y, part_x))
    x, y, part_x, part_y = x[order], y[order], part_x[order], part_y[order]
    turns = np.flatnonzero((np.diff(part_x) != 0) | (np.diff(part_y) != 0)) + 1
    for a, b in itertools.pairwise([0, *turns, len(x)]):
        of = np.array([*name, part_x[a], part_y[a]], np.uint64)
        cell = texts.mix(of * texts.constants(len(of), 41), 42).sum(dtype=np.uint64)
        asking, first = np.unique(x[a:b], return_index=True)
        bounds = np.append(first, b - a)
        for row, start, end in zip(asking, bounds[:-1], bounds[1:], strict=True):
            yield cell.view(np.int64), nodes[row], nodes[y[a + start : a + end]]
        for row in np.setdiff1d(y[a:b], asking):
            yield cell.view(np.int64), nodes[row], nodes[:0]


def _merge(rows: DataFrame, hot: Broadcast) -> DataFrame:
    """Cells of pairs of different components with enough equal coordinates, from whole block pairs.

    A pair of nodes is named under the longest list that both have in their prefix, so it
    comes out once, whatever number of lists they share, and groups stay in few lists.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in tables.whole_groups(batches, ["pair", "block_a", "block_b"], 1 << 13):
            pair, nodes, parts, sides, sizes, block_a, block_b = (
                table.column(c).to_numpy()
                for c in ("pair", "node", "component", "side", "n_shingles", "block_a", "block_b")
            )
            posted, checked = values_of(table.column("signature"))
            first = prefix_pairs(posted, *hot.value)
            keys = naming_keys(first, *hot.value)
            last = np.iinfo(np.uint64).max
            found = []
            for a, b in itertools.pairwise(bounds):
                if b - a < 2 or (parts[a:b] == parts[a]).all():
                    continue
                one, name = block_a[a] == block_b[a], pair[a : a + 1].view(np.uint64)
                key = naming_keys(name, *hot.value)[0]
                left = np.arange(a, b) if one else a + np.flatnonzero(sides[a:b] == 0)
                right = left if one else a + np.flatnonzero(sides[a:b] == 1)
                x, y = _colliding(posted[left], posted[right])
                x, y = left[x], right[y]
                rest = (parts[x] != parts[y]) & (nodes[x] != nodes[y]) & ((not one) | (x < y))
                rest &= 100 * np.minimum(sizes[x], sizes[y]) >= 75 * np.maximum(sizes[x], sizes[y])
                x, y = x[rest], y[rest]
                close = np.zeros(len(x), bool)
                for start in range(0, len(x), 1 << 13):
                    i, j = x[start : start + (1 << 13)], y[start : start + (1 << 13)]
                    equal = (posted[i] == posted[j]).sum(axis=1)
                    equal += (checked[i] == checked[j]).sum(axis=1)
                    common = np.where(first[i] == first[j], keys[i], last)
                    named = common.min(axis=1) == key
                    close[start : start + (1 << 13)] = named & (equal >= MATCHES_OF_ALL)
                if close.any():
                    of = (name[0], block_a[a], block_b[a])
                    found += _cells(of, nodes, sizes, x[close], y[close])
            if found:
                columns = [pa.array(column) for column in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "node", "partners"])

    return rows.mapInArrow(merge, "cell long, node long, partners array<long>")


def similar_to(items: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of ``others`` are similar to ``items``; all sets are sorted."""
    sizes = np.array([len(other) for other in others])
    linked = np.zeros(len(others), bool)
    fits = np.flatnonzero(
        100 * np.minimum(sizes, len(items)) >= 75 * np.maximum(np.maximum(sizes, len(items)), 1)
    )
    if len(fits):
        flat = np.concatenate([others[k] for k in fits])
        hit = items[np.minimum(np.searchsorted(items, flat), len(items) - 1)] == flat
        starts = np.cumsum(sizes[fits]) - sizes[fits]
        both = np.add.reduceat(hit.astype(np.int64), starts)
        linked[fits] = 100 * both >= 75 * (len(items) + sizes[fits] - both)
    return linked


def _verify_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, list[np.ndarray]] = {}
    asked: dict[int, list[int]] = {}

    def judged(sets: dict[int, list[np.ndarray]], asked: dict[int, list[int]]) -> pa.RecordBatch:
        found = set()
        for node, partners in asked.items():
            # Rows that share a doc_id are one document: any of their texts may link.
            named = [(other, items) for other in partners for items in sets.get(other, ())]
            for own in sets[node]:
                linked = similar_to(own, [items for _, items in named])
                found |= {(max(node, named[k][0]), min(node, named[k][0])) for k in np.flatnonzero(linked)}
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cell = None
    for whole in batches:
        for batch in texts.chunks(iter([whole])):
            words = texts.split_words(batch.column("text"), lower=True)
            hashes = words.hashes()
            rows = zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "partners")), strict=True)
            for row, (at, node, partners) in enumerate(rows):
                if at != cell:
                    yield judged(sets, asked)
                    sets, asked, cell = {}, {}, at
                sets.setdefault(node, []).append(shingles(words, hashes, row))
                if partners:
                    asked[node] = partners
    yield judged(sets, asked)


def confirmed_cells(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of ``cells(cell, node, partners)`` whose full shingle sets are similar.

    A cell gets the text of each of its nodes once, however many partners that has.
    """
    cells = materialize(cells, "cells")
    ids = cells.select(F.col("node").alias("doc_id")).distinct()
    near = materialize(tables.join_by_id(docs.select("doc_id", "text"), ids, "doc_id"), "cell-texts")
    rows = cells.join(near.select(F.col("doc_id").alias("node"), "text"), "node")
    return tables.sorted_by(rows, ["cell"]).mapInArrow(_verify_cells, "a long, b long")


def _stars(shared: DataFrame, parts: DataFrame | None, seed: int) -> DataFrame:
    """``(a, b)``: each node and the leading node of another component it collides with most.

    Every list is led by its node that comes first in an order which all lists share.
    """
    placed = _placed(shared, parts)
    first = F.struct(F.xxhash64("node", F.lit(seed)).alias("rank"), "node", "component")
    leads = placed.groupBy("pair").agg(F.min(first).alias("lead"))
    met = placed.join(leads, "pair").where(F.col("lead.component") != F.col("component"))
    counts = met.groupBy("node", F.col("lead.node").alias("lead")).count()
    best = counts.groupBy(F.col("node").alias("a")).agg(
        F.max(F.struct("count", "lead")).alias("best")
    )
    return best.select("a", F.col("best.lead").alias("b"))


def _placed(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return shared.withColumn("component", F.col("node"))
    return shared.join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no shingles and are linked with nothing. Rows that share a
    doc_id count as one document. A null doc_id takes no part in naming a component: such a
    row is answered with the component of its set, or null. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_signatures, SIGNATURES), "signatures")
    nodes = materialize(
        signed.where(F.col("set_key").isNotNull())
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("node"),
            F.max("n_shingles").alias("n_shingles"),
            F.min("signature").alias("signature"),
        ),
        "nodes",
    )
    named = nodes.where(F.col("node").isNotNull())
    hot = docs.sparkSession.sparkContext.broadcast(hot_pairs(named))
    postings = materialize(_postings(named, hot), "postings")
    lists = postings.groupBy("pair").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    shared = materialize(postings.join(lists, "pair"), "shared-postings")
    links, parts = None, None
    for seed in range(ROUNDS):
        close = agreeing(_stars(shared, parts, seed), named)
        found = materialize(confirmed(close, docs), "star-links")
        links = found if links is None else links.union(found)
        parts = graph.components(links)
    placed = _placed(shared, parts)
    mixed = (
        placed.groupBy("pair")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("pair")
    )
    rows = placed.join(mixed, "pair").join(
        named.select("node", "n_shingles", "signature"), "node"
    )
    blocks = tables.block_pairs(rows, "size", F.xxhash64("node"), BLOCK)
    cells = _merge(tables.sorted_by(blocks, ["pair", "block_a", "block_b"]), hot)
    links = links.union(confirmed_cells(cells, docs))
    with_set = signed.where(F.col("set_key").isNotNull()).select("doc_id", "n_shingles", "set_key")
    found = with_set.join(nodes.select("set_key", "node"), "set_key").join(
        graph.components(links), "node", "left"
    )
    component = F.coalesce("component", "node", "doc_id")
    linked = found.select("doc_id", "n_shingles", component.alias("component_id"))
    alone = signed.where(F.col("set_key").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return linked.union(alone).withColumn("kept", kept)


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, one document of each class: that of the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together; those without stay.
    """
    gone = near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull())
    ids = materialize(gone.select("doc_id").distinct(), "copies")
    return tables.join_by_id(docs, ids, "doc_id", "left_anti")

"""How the sources of a language differ in their terms: exact divergences from columnar counts.

``mapInArrow`` turns batches of texts into partial counts with Arrow's compute functions: lower-case,
split by a pattern, encode as a dictionary, count with hash aggregations; counts of a task are merged
before they leave it. One exchange by language and term brings the partial counts together, and term
totals and document frequencies come from the same exchange. The kept counts are dealt into shards by
term, and a shard adds up the differences of all pairs of sources over its terms as matrices; only sums
of pairs leave it. A pair of sources with more than ``SOURCES`` others in its language meets in blocks.

Defined results: a NULL text, language or source is ''. A language without kept terms has value 0 for all
its pairs. Extra columns are ignored; repeated rows count as often as they occur; ids are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.tables import whole_groups
from tagloom.llm.texts import chunks, utf8
from tagloom.shared import materialize

# What stands between terms: ASCII that is no letter. All else belongs to terms.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 30
ADDED = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
# Rows of merged counts that a task holds before it passes them on.
HELD_ROWS = 1 << 19
# Counts a shard is made for, sources whose pairs are one block, cells of a dense block.
SHARD_ROWS = 1 << 18
SOURCES = 1024
DENSE_CELLS = 1 << 20

COUNTS_SCHEMA = "lang string, source string, term string, n long, docs long"


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    shard_rows: int = SHARD_ROWS,
    block_sources: int = SOURCES,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources and the terms each overuses."""
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    cells = materialize(_kept(counts, least_documents), "kept-counts")
    groups = materialize(_groups(counts, cells), "groups")
    pairs = _pairs(cells, groups, shard_rows, block_sources)
    return _ranked(pairs, None, "pair").unionByName(_ranked(_overused(cells, groups), top_terms, "term"))


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``(lang, source, term, n, docs)``; the row without a term counts the documents of the group."""
    read = docs.select(
        *[
            F.coalesce(F.col(given).cast("string"), F.lit("")).alias(name)
            for given, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))
        ]
    )
    partial = read.mapInArrow(_partial_counts, COUNTS_SCHEMA).repartition("lang", "term")
    # Dealt by part of the keys: this needs no exchange of its own.
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in chunks(batches):
        table = _count(batch)
        held.append(table)
        rows += table.num_rows
        if rows > HELD_ROWS:
            merged = _merged(held)
            held, rows = [merged], merged.num_rows
            if rows > HELD_ROWS // 2:
                yield from merged.to_batches()
                held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def _count(batch: pa.RecordBatch) -> pa.Table:
    """Counts of one chunk: terms by document first, then documents and terms by group."""
    lists = pc.split_pattern_regex(pc.ascii_lower(_from_zero(batch.column("text"))), BETWEEN_TERMS)
    terms = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists)
    there = pc.not_equal(terms, "")
    encoded = pc.dictionary_encode(terms.filter(there))
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    in_documents = pa.table({"row": rows.filter(there), "term": encoded.indices}).group_by(
        ["row", "term"], use_threads=False
    ).aggregate([([], "count_all")])
    of = in_documents.column("row")
    in_groups = pa.table(
        {
            "lang": batch.column("lang").take(of),
            "source": batch.column("source").take(of),
            "term": in_documents.column("term"),
            "n": in_documents.column("count_all"),
        }
    ).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    documents = pa.table([batch.column("lang"), batch.column("source")], ["lang", "source"]).group_by(
        ["lang", "source"], use_threads=False
    ).aggregate([([], "count_all")])
    none = pa.nulls(documents.num_rows, pa.large_string())
    found = pa.table(
        {
            "lang": in_groups.column("lang"),
            "source": in_groups.column("source"),
            "term": encoded.dictionary.take(in_groups.column("term")),
            "n": in_groups.column("n_sum"),
            "docs": in_groups.column("n_count"),
        }
    )
    counted = documents.column("count_all")
    marks = pa.table(
        [documents.column("lang"), documents.column("source"), none, pa.array(np.zeros(len(none), np.int64)), counted],
        found.column_names,
    )
    return pa.concat_tables([found, marks]).cast(_ARROW_COUNTS)


def _from_zero(texts: pa.Array) -> pa.Array:
    """The same strings with offsets from 0 on: ``ascii_lower`` of a slice gives offsets out of bounds."""
    data, offsets = utf8(texts)
    return pa.Array.from_buffers(
        pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )


_ARROW_COUNTS = pa.schema(
    [
        ("lang", pa.string()),
        ("source", pa.string()),
        ("term", pa.string()),
        ("n", pa.int64()),
        ("docs", pa.int64()),
    ]
)


def _merged(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    summed = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate(
        [("n", "sum"), ("docs", "sum")]
    )
    return summed.rename_columns(_ARROW_COUNTS.names).cast(_ARROW_COUNTS)


def _kept(counts: DataFrame, least_documents: int) -> DataFrame:
    """``(lang, term, source, n, total)`` of the terms that enough documents of the language hold."""
    of_term = Window.partitionBy("lang", "term")
    return (
        counts.where(F.col("term").isNotNull())
        .select(
            "lang",
            "term",
            "source",
            "n",
            F.sum("n").over(of_term).alias("total"),
            F.sum("docs").over(of_term).alias("_docs"),
            F.row_number().over(of_term.orderBy("source")).alias("nth"),
        )
        .where(F.col("_docs") >= least_documents)
        .drop("_docs")
    )


def _groups(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """``(lang, source, idx, sources, divisor, lang_divisor)``: every group with its index in the language.

    One row per group, as many as the result has groups; the divisors are N + 5 V.
    """
    kept = cells.groupBy("lang").agg(
        F.sum((F.col("nth") == 1).cast("long")).alias("v"), F.sum("n").alias("lang_n")
    )
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    in_lang = Window.partitionBy("lang")
    smoothed = F.coalesce("v", F.lit(0)) * ADDED
    return (
        counts.where(F.col("term").isNull())
        .select("lang", "source")
        .join(kept, "lang", "left")
        .join(sums, ["lang", "source"], "left")
        .select(
            "lang",
            "source",
            (F.row_number().over(in_lang.orderBy("source")) - 1).alias("idx"),
            F.count(F.lit(1)).over(in_lang).alias("sources"),
            (F.coalesce("group_n", F.lit(0)) + smoothed).alias("divisor"),
            (F.coalesce("lang_n", F.lit(0)) + smoothed).alias("lang_divisor"),
        )
    )


def share(count: Column, divisor: Column) -> Column:
    """``1 + floor(10^9 * (count + 5) / divisor)`` in longs: nine digits by long division, three at a time."""
    divisor = F.nullif(divisor, F.lit(0))
    rest = count + F.lit(ADDED)
    out = F.call_function("div", rest, divisor)
    for _ in range(3):
        rest = (rest % divisor) * F.lit(1000)
        out = out * F.lit(1000) + F.call_function("div", rest, divisor)
    return out + F.lit(1)


def _ranked(rows: DataFrame, ranks: int | None, part: str) -> DataFrame:
    """Ranked by value within each group; with a limit every partition keeps only so many before the exchange."""
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if ranks is None else ranked.where(F.col("rank") <= ranks)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _overused(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of terms with a larger share in the group than in the language."""
    joined = cells.join(groups.select("lang", "source", "divisor", "lang_divisor"), ["lang", "source"])
    p = share(F.col("n"), F.col("divisor"))
    q = share(F.col("total"), F.col("lang_divisor"))
    return (
        joined.where(F.col("n") > 0)
        .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
        .where(F.col("value") > 0)
    )


def _pairs(cells: DataFrame, groups: DataFrame, shard_rows: int, block_sources: int) -> DataFrame:
    """``(lang, source, item, value)`` of all ordered pairs of sources of a language."""
    shards = max(1, -(-cells.count() // shard_rows))
    totals = groups.select(
        "lang",
        "idx",
        "sources",
        F.coalesce(share(F.lit(0), F.col("divisor")), F.lit(0)).alias("p"),
        F.lit(None).cast("string").alias("term"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    placed = cells.join(groups.select("lang", "source", "idx", "sources", "divisor"), ["lang", "source"])
    counted = placed.select(
        "lang",
        "idx",
        "sources",
        share(F.col("n"), F.col("divisor")).alias("p"),
        "term",
        F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"),
    )
    rows = totals.unionByName(counted)
    # More sources than a block has: every two blocks meet in a group of their own.
    own = (F.col("idx") / F.lit(block_sources)).cast("int")
    blocks = (F.col("sources") + F.lit(block_sources - 1)) / F.lit(block_sources)
    rows = rows.withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))
    )
    dealt = rows.select(
        "lang",
        "shard",
        F.least("_own", "_other").alias("low"),
        F.greatest("_own", "_other").alias("high"),
        "term",
        "idx",
        "p",
    )
    keys = ["lang", "shard", "low", "high"]
    merged = dealt.repartition(*keys).sortWithinPartitions(*keys, F.col("term").asc_nulls_first(), "idx")
    summed = (
        merged.mapInArrow(_differences(block_sources), "lang string, a int, b int, value long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    both = summed.unionByName(
        summed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    )
    named = groups.select("lang", F.col("idx").alias("a"), "source")
    other = groups.select("lang", F.col("idx").alias("b"), F.col("source").alias("item"))
    return both.join(named, ["lang", "a"]).join(other, ["lang", "b"]).select(
        "lang", "source", "item", "value"
    )


def _differences(block_sources: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Shard | None = None
        keys = ["lang", "shard", "low", "high"]
        for table, bounds in whole_groups(batches, [*keys, "term"]):
            heads = table.take(pa.array(bounds[:-1]))
            of = list(zip(*(heads.column(k).to_pylist() for k in keys)))
            idx, p = table.column("idx").to_numpy(), table.column("p").to_numpy()
            first = 0
            while first < len(of):
                last = first
                while last < len(of) and of[last] == of[first]:
                    last += 1
                lo, hi = bounds[first], bounds[first + 1]
                if current is None or current.key != of[first]:
                    if current is not None:
                        yield current.batch()
                    # The rows without a term come first: every source with its share of a missing term.
                    current = _Shard(of[first], block_sources, idx[lo:hi], p[lo:hi])
                    first, lo = first + 1, hi
                if first < last:
                    hi = bounds[last]
                    sizes = np.diff(bounds[first : last + 1])
                    current.add(np.repeat(np.arange(len(sizes)), sizes), idx[lo:hi], p[lo:hi])
                first = last
        if current is not None:
            yield current.batch()

    return summed


class _Shard:
    """Sums over the terms of one shard for all pairs of two blocks of sources."""

    def __init__(self, key: tuple, block_sources: int, idx: np.ndarray, nothing: np.ndarray):
        self.key, self.idx, self.nothing = key, idx, nothing
        self.block = idx // block_sources
        self.sums = np.zeros((len(idx), len(idx)), np.int64)
        self.width = max(1, DENSE_CELLS // max(1, len(idx)))

    def add(self, term: np.ndarray, idx: np.ndarray, p: np.ndarray) -> None:
        """Cells of whole terms, numbered from 0 on: a dense block of terms at a time."""
        for start in range(0, int(term[-1]) + 1, self.width):
            lo, hi = np.searchsorted(term, [start, start + self.width])
            n = int(term[hi - 1]) - start + 1
            dense = np.repeat(self.nothing[:, None], n, axis=1)
            dense[np.searchsorted(self.idx, idx[lo:hi]), term[lo:hi] - start] = p[lo:hi]
            for k in range(len(self.idx) - 1):
                self.sums[k, k + 1 :] += np.abs(dense[k + 1 :] - dense[k]).sum(axis=1)

    def batch(self) -> pa.RecordBatch:
        lang, _, low, high = self.key
        a, b = np.triu_indices(len(self.idx), 1)
        # Sources of one block meet where that block meets itself, and only there.
        here = (self.block[a] == self.block[b]) == (low == high)
        a, b = a[here], b[here]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(a), pa.string()),
                pa.array(self.idx[a].astype(np.int32)),
                pa.array(self.idx[b].astype(np.int32)),
                pa.array(self.sums[a, b]),
            ],
            ["lang", "a", "b", "value"],
        )

"""Table helpers: bounded broadcasts, groups of sorted rows, blocks of hot groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.shared import BROADCAST_BYTES, broadcast_size, materialize

# Spark keeps about so many bytes for each row of a broadcast hash table of single ids.
ID_ROW_BYTES = 64


def join_by_id(rows: DataFrame, ids: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the smaller table ``ids`` on one column.

    ``ids`` is broadcast when its counted rows fit the broadcast limit and is shuffled
    otherwise; the rows that come out are the same.
    """
    small = ids.count() * ID_ROW_BYTES <= BROADCAST_BYTES and len(ids.columns) <= 2
    return rows.join(F.broadcast(ids) if small else ids, on, how)


# Rows that a hot-key table broadcasts at most, whatever the input's size.
HOT_KEYS = 4096


def join_hot(
    rows: DataFrame, table: DataFrame, key: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row per ``key``, NULL a key too), all rows kept.

    A table whose measured size fits is broadcast. Of a larger one only the rows of hot keys are,
    those that at least one in ``HOT_KEYS`` of the rows have, so that no more than ``HOT_KEYS`` of them
    exist; rows of other keys are shuffled, and no key of them fills a task.
    """
    table = materialize(table, "keys")
    names = [c for c in table.columns if c != key]
    renamed = table.withColumnRenamed(key, "_key")

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(right, left[key].eqNullSafe(right["_key"]), "left")
        return both.select(*rows.columns, *names)

    texts = [c for c, kind in table.dtypes if kind == "string"]
    if broadcast_size(table, *texts) <= broadcast_bytes:
        return joined(rows, F.broadcast(renamed))
    counts = rows.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.where(F.col("_n") * HOT_KEYS >= F.lit(rows.count())).select("_of"), "hot")
    is_hot = renamed["_key"].eqNullSafe(hot["_of"])
    here = rows[key].eqNullSafe(hot["_of"])
    near = joined(
        rows.join(F.broadcast(hot), here, "left_semi"),
        F.broadcast(renamed.join(F.broadcast(hot), is_hot, "left_semi")),
    )
    far = joined(
        rows.join(F.broadcast(hot), here, "left_anti"),
        renamed.join(F.broadcast(hot), is_hot, "left_anti"),
    )
    return near.unionByName(far)


def in_training(id_col: str, modulus: int, held_out: int) -> Column:
    """Whether a row is learnt from: crc32 of its id as text leaves another remainder."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(remainder != held_out, F.lit(True))


def sorted_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows dealt by ``keys`` and sorted, so that equal keys stand together in one partition."""
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], limit_rows: int = 1 << 16
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the bounds of the groups in them.

    A table holds groups until it has ``limit_rows`` rows; a group is never cut.
    """
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows < limit_rows:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        bounds = group_bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
            table = table.slice(bounds[-2])
        kept, rows = table.to_batches(), table.num_rows
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, group_bounds(table, keys)


def group_bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(n + 1, bool)
    new[0] = new[n] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:n] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def block_pairs(rows: DataFrame, size_col: str, spread: Column, block_rows: int) -> DataFrame:
    """Adds ``block_a <= block_b`` and ``side`` so that groups with any two rows are bounded.

    A group of ``size_col`` rows is dealt into blocks of about ``block_rows``; each row goes to
    every pair of blocks that its own block is part of. Side 0 belongs to ``block_a``, side 1 to
    ``block_b``; with equal blocks all rows have side 0 and every two of them are to be compared.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size_col) / F.lit(block_rows))).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn(
        "_block", F.pmod(spread, F.col("_blocks")).cast("int")
    )
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return paired.select(
        *rows.columns,
        F.least("_block", "_other").alias("block_a"),
        F.greatest("_block", "_other").alias("block_b"),
        (F.col("_block") > F.col("_other")).cast("int").alias("side"),
    )

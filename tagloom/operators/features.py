"""Label index and term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import explode_once
from tagloom.shared import materialize


def label_index(docs: DataFrame, label_col: str) -> DataFrame:
    """``(label, docs, label_idx)``: most frequent label first, then by name.

    The ordering sees one row per class, after the counts were combined on the map side.
    """
    counts = docs.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.desc("docs"), "label")
    return counts.withColumn("label_idx", F.row_number().over(order) - 1)


def term_counts(docs: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """``(id, term, tf)``, one row per distinct term of a record; records that share an id are one.

    A record's terms are counted in its row, so no task holds the terms of many records; only records that
    share their id with others, or have none, are added up by a shuffle.
    """
    ids = docs.groupBy(F.col(id_col).alias("_shared")).agg(F.count(F.lit(1)).alias("_records"))
    shared = materialize(ids.where(F.col("_records") > 1).select("_shared"), "shared-ids")
    if shared.isEmpty():
        return _counted(docs, id_col, tokens_col)
    same = F.col(id_col).eqNullSafe(F.col("_shared"))
    alone = _counted(docs.join(shared, same, "left_anti"), id_col, tokens_col)
    parts = _counted(docs.join(shared, same, "left_semi"), id_col, tokens_col)
    return alone.unionByName(parts.groupBy(id_col, "term").agg(F.sum("tf").alias("tf")))


def _counted(docs: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    counts = docs.select(id_col, explode_once(_runs(F.sort_array(F.array_compact(tokens_col)))).alias("_run"))
    return counts.where(F.col("_run").isNotNull()).select(id_col, "_run.term", "_run.tf")


def _runs(words: Column) -> Column:
    """``(term, tf)`` of the runs of equal words in a sorted array."""

    def starts(ordered: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return F.array(F.when(F.size(ordered) > 0, first).otherwise(F.array().cast("array<int>")))

    def run(ordered: Column, at: Column, first: Column, i: Column) -> Column:
        end = F.coalesce(F.get(at, i + 1), F.size(ordered))
        return F.struct(F.get(ordered, first).alias("term"), (end - first).cast("long").alias("tf"))

    # Arrays of one element bind the sorted words, and where their runs start, once.
    return F.flatten(
        F.transform(
            F.array(words),
            lambda ordered: F.flatten(
                F.transform(
                    starts(ordered), lambda at: F.transform(at, lambda first, i: run(ordered, at, first, i))
                )
            ),
        )
    )

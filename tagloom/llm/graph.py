"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes of ``links(a, b)``: the smallest node reachable.

    Every round points each node at its smallest neighbour, shortens the pointers until they
    name roots, and contracts the links to those between roots. Each round at least halves
    the nodes of a chain, so a few rounds do. Rounds are written tables: a lost executor
    costs a task, not a round. Hot nodes are combined before each exchange; all joins may be split
    by adaptive execution.
    """
    edges = materialize(
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        pointers = materialize(
            nearest.select("node", F.least("node", "near").alias("component")), "pointers"
        )
        pointers = _shorten(pointers)
        labels = pointers if labels is None else _follow(labels, pointers)
        edges = materialize(_contract(edges, pointers), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _step(labels: DataFrame, pointers: DataFrame) -> DataFrame:
    """Each label replaced by what it points to; labels that point nowhere stay."""
    to = pointers.select(F.col("node").alias("component"), F.col("component").alias("_root"))
    return labels.join(to, "component", "left").select(
        "node", F.coalesce("_root", "component").alias("component"), F.col("component").alias("_was")
    )


def _shorten(pointers: DataFrame) -> DataFrame:
    while True:
        stepped = materialize(_step(pointers, pointers), "pointers")
        pointers = stepped.select("node", "component")
        if stepped.where(F.col("component") != F.col("_was")).isEmpty():
            return pointers


def _follow(labels: DataFrame, pointers: DataFrame) -> DataFrame:
    return materialize(_step(labels, pointers).select("node", "component"), "labels")


def _contract(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    def root(df: DataFrame, col: str) -> DataFrame:
        to = pointers.select(F.col("node").alias(col), F.col("component").alias("_root"))
        return df.join(to, col).drop(col).withColumnRenamed("_root", col)

    moved = root(root(edges, "a"), "b").where(F.col("a") != F.col("b"))
    return moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate between 0 and 2, exponentially tilted by its size: the odds of the
rate are exp(lambda * size / mean size of the source). The rates are those nearest to 1 in
(bounded) entropy whose words add up to the source's target. The convex dual has one unknown per
source; guarded Newton iterations solve it over counts of equal sizes, not over documents. Rates
become whole copies: cumulative rates in order of size are rounded, so that errors do not
add up, and the copies of equal sizes go to the documents with the first hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.shared import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
# Relative error at which a source is solved, and the iterations that bisection alone would need.
PRECISION = 1e-7
ITERATIONS = 60
# Iterations between two written tables.
STRIDE = 4
STEEPEST = 60.0
# Parts that documents of one source and size are ranked in.
PARTS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(
        F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)
    ).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source_key, source_size, target)``: shares by weight, held to twice the size.

    With the sources in order of size over weight, the first k are held at their limit and the
    others share the rest by weight; k is the smallest for which none of them is above.
    """
    sources = sized.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy("source_key")
    ranked = sources.withColumn("_place", (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("_place"))
    limited = ranked.select(
        "source_key",
        "source_size",
        weight.alias("weight"),
        (F.col("source_size") * MOST_COPIES).cast("double").alias("limit"),
    )
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "source_key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = limited.select(
        "*",
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("held"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("held_weight"),
        (F.sum("source_size").over(everything) * SHARE).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.row_number().over(by_level).alias("place"),
    )
    level = (F.col("total") - F.col("held")) / (F.col("all_weight") - F.col("held_weight"))
    fits = F.col("weight") * level <= F.col("limit")
    first = F.min(F.when(fits, F.struct("place", level.alias("level")))).over(everything)
    found = levels.select("*", first["level"].alias("level"))
    target = F.least(F.col("limit"), F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return found.select("source_key", "source_size", target.alias("target"))


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.lit(float(MOST_COPIES)) / (1 + F.exp(-F.least(tilt * size / mean, F.lit(500.0))))


def tilts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source_key, tilt, mean, full)`` by Newton iterations kept inside a bracket.

    A target at the limit needs no tilt: ``full`` says that every rate is 2.
    """
    means = sized.groupBy("source_key").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")
    )
    state = targets.join(means, "source_key").select(
        "source_key",
        "target",
        F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("mean"),
        (F.col("target") >= F.col("source_size") * MOST_COPIES).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(0.0).alias("error"),
        F.lit(-STEEPEST).alias("low"),
        F.lit(STEEPEST).alias("high"),
    )
    state = materialize(state, "tilts")
    for step in range(ITERATIONS):
        rows = sized.join(state, "source_key")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size")
        slope = words * F.col("size") / F.col("mean") * rate * (1 - rate / MOST_COPIES)
        sums = rows.groupBy("source_key").agg(
            F.sum(words * rate).alias("reached"), F.sum(slope).alias("slope")
        )
        error = F.col("reached") - F.col("target")
        low = F.when(error < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - error / F.col("slope")
        inside = (newton > F.col("_low")) & (newton < F.col("_high")) & (F.col("slope") > 0)
        moved = F.when(error == 0, F.col("tilt")).when(inside, newton)
        state = (
            state.join(sums, "source_key")
            .withColumns({"_low": low, "_high": high})
            .withColumn("_tilt", moved.otherwise((F.col("_low") + F.col("_high")) / 2))
            .select(
                "source_key", "target", "mean", "full", F.col("_tilt").alias("tilt"), error.alias("error"),
                F.col("_low").alias("low"), F.col("_high").alias("high"),
            )
        )
        if step % STRIDE == STRIDE - 1:
            state = materialize(state, "tilts")
            open_ = ~F.col("full") & (F.abs("error") > F.col("target") * PRECISION)
            if state.where(open_).isEmpty():
                break
    return state


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, ``copy`` counted from 1.

    All columns of ``docs`` are kept but those that are named like a column of ``mixed``.
    """
    made = {"size", "source_size", "target", "taken", "copies", "copy", "source_key", "rank", "part",
            "place", "n", "group_n", "group_copies", "offset"}
    carry = [c for c in docs.columns if c not in made and c != "doc_id"]
    taken = mixed(docs, carry)
    copies = taken.where(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
    return copies.select("doc_id", *carry, "size", "source_size", "target", "copy")


def mixed(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    A null text has size 0 and is taken with 0 words; a null source is a source of its own, the
    last. Repeated rows are documents of their own; with a null or repeated doc_id only the hash of
    all its columns tells rows apart, and equal rows share copies in any order. An empty
    table gives an empty one. Of the other columns of ``docs`` those in ``carry`` are kept.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    rows = docs.select(
        "doc_id",
        *carry,
        key.alias("source_key"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("rank"),
    ).withColumn("part", F.pmod(F.col("rank"), F.lit(PARTS)).cast("int"))
    if not carry:
        rows = materialize(rows, "mix-sizes")
    parts = materialize(
        rows.groupBy("source_key", "size", "part").agg(F.count(F.lit(1)).alias("n")), "mix-parts"
    )
    sized = materialize(
        parts.groupBy("source_key", "size").agg(F.sum("n").alias("n")), "mix-counts"
    )
    targets = materialize(source_targets(sized), "mix-targets")
    solved = materialize(tilts(sized, targets), "mix-tilts")
    rated = sized.join(solved.select("source_key", "tilt", "mean", "full"), "source_key")
    rate = F.when(F.col("full"), F.lit(float(MOST_COPIES))).otherwise(
        _rate(F.col("tilt"), F.col("size"), F.col("mean"))
    )
    by_size = Window.partitionBy("source_key").orderBy("size")
    upto = by_size.rowsBetween(Window.unboundedPreceding, 0)
    cumulative = F.floor(F.sum(F.col("n") * F.col("rate")).over(upto) + 0.5).cast("long")
    dealt = rated.select("source_key", "size", "n", rate.alias("rate")).select(
        "source_key", "size", "n", cumulative.alias("upto")
    )
    copies = F.col("upto") - F.coalesce(F.lag("upto").over(by_size), F.lit(0))
    groups = dealt.select("source_key", "size", F.col("n").alias("group_n"), copies.alias("group_copies"))
    before = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = parts.join(groups, ["source_key", "size"]).select(
        "source_key", "size", "part", "group_n", "group_copies",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    in_part = Window.partitionBy("source_key", "size", "part").orderBy("rank", "doc_id")
    placed = rows.withColumn("place", F.row_number().over(in_part)).join(
        offsets, ["source_key", "size", "part"]
    )
    base = F.floor(F.col("group_copies") / F.col("group_n")).cast("long")
    extra = F.col("group_copies") - base * F.col("group_n")
    own = base + (F.col("offset") + F.col("place") <= extra).cast("long")
    return placed.join(targets, "source_key").select(
        "doc_id",
        *carry,
        "size",
        "source_size",
        "target",
        (own * F.col("size")).alias("taken"),
        own.alias("copies"),
    )

"""Hold-out split, confusion table, weighted quality metrics and column summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_BELOW = "cc"


def in_training_part(id_col: Column) -> Column:
    """About 80 % of all ids (204 of 256 hash bytes), the same whatever the partitioning."""
    return F.substring(F.md5(id_col.cast("string").cast("binary")), 1, 2) < F.lit(TRAIN_BELOW)


def confusion(predictions: DataFrame, label_col: str, prediction_col: str) -> DataFrame:
    """``(label, prediction, n)``, combined on the map side."""
    return predictions.groupBy(
        F.col(label_col).alias("label"), F.col(prediction_col).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def metrics(confused: DataFrame) -> DataFrame:
    """One row ``(accuracy, weighted_precision, weighted_recall, f1)``.

    Works on the confusion table, at most classes x classes rows, so the records are read
    once for all four.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    roles = confused.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("actual"),
                    zero.alias("predicted"),
                    hit.alias("hits"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    zero.alias("actual"),
                    F.col("n").alias("predicted"),
                    zero.alias("hits"),
                ),
            )
        ).alias("role")
    ).select("role.*")
    per_class = (
        roles.groupBy("class")
        .agg(*[F.sum(name).alias(name) for name in ("actual", "predicted", "hits")])
        .where(F.col("actual") > 0)
    )
    actual, predicted, hits = (F.col(name).cast("double") for name in ("actual", "predicted", "hits"))
    precision = F.when(predicted > 0, hits / predicted).otherwise(0.0)
    recall = hits / actual
    # 2pr / (p + r) written with counts, so that no hit means 0 and not 0/0.
    f1 = 2.0 * hits / (predicted + actual)
    total = F.sum(actual)
    return per_class.agg(
        (F.sum(hits) / total).alias("accuracy"),
        (F.sum(actual * precision) / total).alias("weighted_precision"),
        (F.sum(actual * recall) / total).alias("weighted_recall"),
        (F.sum(actual * f1) / total).alias("f1"),
    )


def report(measured: DataFrame) -> DataFrame:
    """The four metrics as one text of four lines, in column ``report``."""
    lines = [
        F.concat(F.lit(f"{title}: "), F.col(name).cast("string"))
        for title, name in (
            ("Accuracy", "accuracy"),
            ("Precision", "weighted_precision"),
            ("Recall", "weighted_recall"),
            ("F1", "f1"),
        )
    ]
    return measured.select(F.concat_ws("\n", *lines).alias("report"))


def summarize(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """``(column_name, count, mean, stddev, min, max)`` per column, from one pass.

    ``min`` and ``max`` are strings; text columns have neither mean nor deviation.
    """
    none = F.lit(None).cast("double")
    parts = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.count(name).alias("count"),
            (F.avg(name) if name in numeric else none).alias("mean"),
            (F.stddev_samp(name) if name in numeric else none).alias("stddev"),
            F.min(name).cast("string").alias("min"),
            F.max(name).cast("string").alias("max"),
        )
        for name in [*numeric, *text]
    ]
    return df.agg(F.array(*parts).alias("summary")).select(F.inline("summary"))

import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tagloom.operators import evaluate


def predictions(spark, seed):
    rng = random.Random(seed)
    rows = [(float(rng.randrange(4)), float(rng.randrange(5))) for _ in range(300)]
    return spark.createDataFrame(rows, "label double, prediction double")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_spark_evaluator(spark, seed):
    df = predictions(spark, seed)
    row = evaluate.metrics(evaluate.confusion(df, "label", "prediction")).first()
    evaluator = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    for ours, theirs in (
        ("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"),
        ("weighted_recall", "weightedRecall"), ("f1", "f1"),
    ):
        assert row[ours] == pytest.approx(evaluator.setMetricName(theirs).evaluate(df), abs=1e-12)
    assert row.weighted_recall == pytest.approx(row.accuracy)


def test_report(spark):
    measured = spark.createDataFrame(
        [(0.5, 0.25, 0.5, 0.125)], "accuracy double, weighted_precision double, weighted_recall double, f1 double"
    )
    assert evaluate.report(measured).first().report == "Accuracy: 0.5\nPrecision: 0.25\nRecall: 0.5\nF1: 0.125"


def test_split_is_stable(spark):
    ids = spark.range(5000)
    part = ids.where(evaluate.in_training_part(F.col("id")))
    assert 0.75 < part.count() / 5000 < 0.85
    again = ids.repartition(7).where(evaluate.in_training_part(F.col("id").cast("string")))
    assert part.exceptAll(again).count() == 0


def test_summary_equals_describe(spark):
    df = predictions(spark, 3).withColumn("name", F.concat(F.lit("n"), F.col("label").cast("string")))
    ours = {r.column_name: r for r in evaluate.summarize(df, ["label", "prediction"], ["name"]).collect()}
    described = {r["summary"]: r for r in df.describe().collect()}
    for name in ("label", "prediction"):
        assert ours[name]["count"] == int(described["count"][name])
        assert ours[name]["mean"] == pytest.approx(float(described["mean"][name]))
        assert ours[name]["stddev"] == pytest.approx(float(described["stddev"][name]))
    for name in ours:
        assert (ours[name]["min"], ours[name]["max"]) == (described["min"][name], described["max"][name])

"""Hashed terms against hashlib; the one-pass one-vs-rest fit against pyspark.ml."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tagloom.functions.patterns import LINEAR_ELASTIC_NET, LINEAR_ITERATIONS, LINEAR_REGULARIZATION
from tagloom.operators import bayes, features, hashing, onevsrest
from tagloom.plans import mllib, segments


def bucket(word, buckets=10_000):
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % buckets


def test_sparse_counts_equal_plain_hashes(spark):
    rows = [("a", ["x", "y", "x", "é", ""]), ("b", []), ("c", None), ("d", ["w%d" % (i % 900) for i in range(30_000)]), (None, ["x"])]
    docs = spark.createDataFrame(rows, "id string, tokens array<string>")
    got = {r.id: r for r in hashing.features(docs, "id", "tokens", 50).collect()}
    for key, words in rows:
        if words is None:
            assert got[key].features is None
            continue
        counts = Counter(bucket(w, 50) for w in words)
        assert [tuple(f) for f in got[key].features] == sorted(counts.items())
        assert (got[key].buckets, got[key].tokens) == (len(counts), len(words))


def test_hashed_model_is_the_bayes_model_over_buckets(spark, training):
    words = training.select("appId", "segment", F.split("clean_description", " ").alias("tokens"))
    model = hashing.fit(words, "segment", "tokens", buckets=7)
    assert model.features == 7
    terms = {(r.label, r.term): r.n for r in model.term_rows().collect()}
    expected = Counter(
        (r.segment, str(bucket(w, 7))) for r in words.collect() for w in r.tokens
    )
    assert terms == expected
    named = words.withColumn("tokens", hashing.as_terms(F.col("tokens"), 7))
    plain = bayes.class_scores(named, bayes.fit(named, "segment", features=7), "appId")
    hashed = hashing.class_scores(words, model, "appId", "tokens")
    assert sorted(map(str, plain.collect())) == sorted(map(str, hashed.collect()))


@pytest.fixture(scope="module")
def slotted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.col("doc_id").cast("string").alias("appId"),
        F.col("text").alias("description"),
        F.concat(F.lit("s"), F.col("doc_id") % 4, F.when(F.length("text") > 900, "long").otherwise("")).alias("segment"),
    )
    return mllib.slots(segments.prepare_training(docs)).select("segment", "slots").cache()


def test_one_vs_rest_equals_spark_ml(spark, slotted):
    model = onevsrest.fit(slotted, "segment", "slots")
    labels = features.label_index(slotted, "segment")
    assert list(model.labels) == [r.label for r in labels.orderBy("label_idx").collect()]
    vectors = slotted.join(labels.withColumnRenamed("label", "segment"), "segment").select(
        F.col("label_idx").cast("double").alias("label"), array_to_vector("slots").alias("features"), "slots"
    ).cache()
    regression = LogisticRegression(
        maxIter=LINEAR_ITERATIONS, regParam=LINEAR_REGULARIZATION, elasticNetParam=LINEAR_ELASTIC_NET,
        family="multinomial", tol=1e-9,
    )
    fitted = OneVsRest(classifier=regression).fit(vectors)
    for c, of_class in enumerate(fitted.models):
        theirs = of_class.coefficientMatrix.toArray()[1]
        assert np.abs(theirs - np.array(model.weights[c])).max() < 1e-3
        assert abs(of_class.interceptVector[1] - model.intercepts[c]) < 2e-3
    both = onevsrest.predict(model, fitted.transform(vectors).withColumnRenamed("prediction", "ml"), "slots")
    agree = both.select(F.avg((F.col("ml") == F.col("prediction")).cast("int")).alias("a")).first().a
    assert agree >= 0.99 and model.passes < 30


def test_one_vs_rest_without_penalty_and_with_ties(spark):
    rows = [("b", [1.0, 5.0]), ("b", [2.0, 5.0]), ("a", [3.0, 5.0]), ("a", [1.5, 5.0]), (None, [9.0, 5.0]), ("a", None)]
    docs = spark.createDataFrame(rows, "segment string, slots array<double>")
    model = onevsrest.fit(docs, "segment", "slots", regularization=0.0)
    assert model.labels == ("a", "b") and model.weights[0][1] == 0.0
    assert model.weights[0][0] == pytest.approx(-model.weights[1][0], abs=1e-6)
    one = onevsrest.fit(docs.where("segment = 'a'"), "segment", "slots")
    assert {r.predictedLabel for r in onevsrest.predict(one, docs, "slots").where("slots is not null").collect()} == {"a"}
    with pytest.raises(ValueError):
        onevsrest.fit(docs.where("false"), "segment", "slots")

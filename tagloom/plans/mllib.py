"""The same classifier, and its linear variant, as ``pyspark.ml`` pipelines.

Hashed terms bound the model by buckets x classes, so scoring is a map over the records with
no shuffle at all; different words may share a bucket.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.patterns import (
    HASH_BUCKETS,
    LINEAR_BUCKETS,
    LINEAR_ELASTIC_NET,
    LINEAR_ITERATIONS,
    LINEAR_REGULARIZATION,
    SMOOTHING,
)
from tagloom.functions.ranking import top_labels
from tagloom.shared import materialize


def _stages(prepared: DataFrame, buckets: int, segment_col: str) -> tuple[list, IndexToString]:
    indexer = StringIndexer(inputCol=segment_col, outputCol="label").fit(prepared)
    vectorize = [
        indexer,
        Tokenizer(inputCol="clean_description", outputCol="tokens"),
        HashingTF(inputCol="tokens", outputCol="features", numFeatures=buckets),
    ]
    converter = IndexToString(
        inputCol="prediction", outputCol="predictedLabel", labels=indexer.labels
    )
    return vectorize, converter


def fit_hashed_bayes(
    prepared: DataFrame,
    segment_col: str = "segment",
    smoothing: float = SMOOTHING,
    buckets: int = HASH_BUCKETS,
) -> PipelineModel:
    columns = prepared.select(segment_col, "clean_description")
    vectorize, converter = _stages(columns, buckets, segment_col)
    classifier = NaiveBayes(modelType="multinomial", smoothing=smoothing)
    return Pipeline(stages=[*vectorize, classifier, converter]).fit(columns)


def fit_one_vs_rest(
    prepared: DataFrame,
    segment_col: str = "segment",
    buckets: int = LINEAR_BUCKETS,
    parallelism: int = 8,
) -> PipelineModel:
    """One logistic regression per class, ``parallelism`` of them at a time.

    The vectors are written once; the many passes over them do not clean the texts again.
    """
    columns = prepared.select(segment_col, "clean_description")
    vectorize, converter = _stages(columns, buckets, segment_col)
    vectors = materialize(
        PipelineModel(stages=vectorize).transform(columns).select("label", "features"), "vectors"
    )
    regression = LogisticRegression(
        maxIter=LINEAR_ITERATIONS,
        regParam=LINEAR_REGULARIZATION,
        elasticNetParam=LINEAR_ELASTIC_NET,
        family="multinomial",
    )
    one_vs_rest = OneVsRest(classifier=regression, parallelism=parallelism)
    classifier = one_vs_rest.fit(vectors)
    return PipelineModel(stages=[*vectorize, classifier, converter])


def predict(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """Row-wise scoring; a ``segment`` column is not needed and, if present, not looked at."""
    return model.transform(prepared.drop("segment"))


def top_labels_of(model: PipelineModel, prepared: DataFrame, k: int) -> DataFrame:
    """Adds ``labels``, the ``k`` best segments, from the raw scores of the Bayes pipeline."""
    labels = model.stages[-1].getLabels()
    scored = predict(model, prepared).withColumn("scores", vector_to_array("rawPrediction"))
    return scored.withColumn("labels", top_labels(F.col("scores"), labels, k))


def hashed_features(
    docs: DataFrame, tokens_col: str = "tokens", buckets: int = HASH_BUCKETS
) -> DataFrame:
    """Adds ``features``, the sparse hashed term counts."""
    return HashingTF(inputCol=tokens_col, outputCol="features", numFeatures=buckets).transform(docs)


def feature_sizes(hashed: DataFrame, id_col: str) -> DataFrame:
    """``(id, buckets, tokens)``: how many buckets a record fills, and with how many tokens."""
    counts = F.unwrap_udt("features").getField("values")
    return hashed.select(
        id_col,
        F.size(counts).alias("buckets"),
        F.aggregate(counts, F.lit(0.0), lambda total, n: total + n).cast("long").alias("tokens"),
    )


def slots(
    prepared: DataFrame, text_col: str = "clean_description", buckets: int = LINEAR_BUCKETS
) -> DataFrame:
    """Adds ``slots``, the dense hashed counts of the text's tokens, for ``operators.onevsrest``."""
    words = Tokenizer(inputCol=text_col, outputCol="_tokens").transform(prepared)
    hashed = hashed_features(words, "_tokens", buckets)
    return hashed.withColumn("slots", vector_to_array("features")).drop("_tokens", "features")

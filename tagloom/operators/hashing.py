"""Hashed terms that any SQL engine can compute: the bucket of a word follows from its MD5 digest.

A record's counts are one sparse array in bucket order, made from its sorted buckets without a
shuffle. The classifier over buckets is the Bayes model of ``bayes`` with buckets for terms: its size is
bounded by buckets x classes, whatever the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.patterns import HASH_BUCKETS, SMOOTHING
from tagloom.operators import bayes

# Hexadecimal digits of the digest that name the bucket: 32 bits.
DIGITS = 8


def bucket(word: Column, buckets: int = HASH_BUCKETS) -> Column:
    """The first 32 bits of the word's MD5 digest, modulo ``buckets``; NULL for NULL."""
    head = F.conv(F.substring(F.md5(word.cast("binary")), 1, DIGITS), 16, 10).cast("long")
    return (head % F.lit(buckets)).cast("int")


def sparse_counts(tokens: Column, buckets: int = HASH_BUCKETS) -> Column:
    """``array<struct(bucket, n)>`` in bucket order; NULL tokens give NULL, none give none.

    The counts are the distances between the starts of equal runs, so long records take linear time.
    """
    ordered = F.array_sort(F.transform(tokens, lambda word: bucket(word, buckets)))

    def counted(values: Column) -> Column:
        size = F.size(values)
        places = F.sequence(F.lit(0), size - 1)
        starts = F.filter(
            places, lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1))
        )
        return F.transform(
            F.array(starts),
            lambda of: F.transform(
                of,
                lambda start, k: F.struct(
                    F.get(values, start).alias("bucket"),
                    (F.coalesce(F.get(of, k + 1), size) - start).cast("long").alias("n"),
                ),
            ),
        )[0]

    none = F.array().cast("array<struct<bucket:int,n:bigint>>")
    # Arrays of one element bind the sorted buckets once.
    some = F.transform(F.array(ordered), lambda values: F.when(F.size(values) > 0, counted(values)).otherwise(none))[0]
    return F.when(tokens.isNotNull(), some)


def features(docs: DataFrame, id_col: str, tokens_col: str, buckets: int = HASH_BUCKETS) -> DataFrame:
    """``(id, features, buckets, tokens)``: the sparse counts, how many there are and their sum."""
    counted = docs.select(id_col, sparse_counts(F.col(tokens_col), buckets).alias("features"))
    total = F.aggregate("features", F.lit(0).cast("long"), lambda sum_, f: sum_ + f["n"])
    return counted.select(
        id_col, "features", F.size("features").alias("buckets"), total.alias("tokens")
    )


def as_terms(tokens: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Tokens as the names of their buckets."""
    return F.transform(tokens, lambda word: bucket(word, buckets).cast("string"))


def fit(
    docs: DataFrame,
    label_col: str,
    tokens_col: str,
    smoothing: float = SMOOTHING,
    buckets: int = HASH_BUCKETS,
) -> bayes.BayesModel:
    hashed = docs.select(label_col, as_terms(F.col(tokens_col), buckets).alias("tokens"))
    return bayes.fit(hashed, label_col, "tokens", smoothing, buckets)


def class_scores(
    docs: DataFrame, model: bayes.BayesModel, id_col: str, tokens_col: str, **how: object
) -> DataFrame:
    """``bayes.class_scores`` of a model that ``fit`` returned."""
    hashed = docs.withColumn("_hashed", as_terms(F.col(tokens_col), model.features))
    return bayes.class_scores(hashed, model, id_col, "_hashed", **how)

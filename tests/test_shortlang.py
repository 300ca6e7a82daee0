"""Languages of short texts against plain products of probabilities."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.operators import evaluate, shortlang

TRAINING = [("en", "the cat and the dog"), ("de", "der Hund und die Katze"), ("fr", "le chat et le chien, été"), (None, "x"), ("en", None), ("en", "")]


def plain_grams(value):
    words = re.sub(r"[\W\d_]+", " ", value.lower()).split()
    for word in words:
        padded = f" {word} "
        yield from word
        yield from (padded[i : i + 2] for i in range(len(padded) - 1))
        yield from (padded[i : i + 3] for i in range(len(padded) - 2))


def plain_detect(value):
    counts = defaultdict(Counter)
    for lang, learnt in TRAINING:
        if lang and learnt:
            counts[lang].update(plain_grams(learnt))
    posterior = {lang: 1 / len(counts) for lang in counts}
    for gram in plain_grams(value or ""):
        if not any(gram in c for c in counts.values()):
            continue
        for lang, c in counts.items():
            posterior[lang] *= c[gram] / sum(n for g, n in c.items() if len(g) == len(gram)) + 0.5 / 10_000
        total = sum(posterior.values())
        posterior = {lang: p / total for lang, p in posterior.items()}
    best = max(posterior, key=posterior.get)
    return best if posterior[best] >= 0.9999 else None


@pytest.fixture(scope="module")
def known(spark):
    return shortlang.profiles(spark.createDataFrame(TRAINING, "lang string, text string"), "text", "lang")


def test_grams_are_those_of_the_words(spark):
    values = ["The  cat's 3 ÉTÉS!", "a", "", "12 3", "x-y"]
    df = spark.createDataFrame([(v,) for v in values], "t string").select("t", shortlang.grams(F.col("t")).alias("g"))
    assert {r.t: sorted(r.g) for r in df.collect()} == {v: sorted(plain_grams(v)) for v in values}


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_detection_equals_iterated_products(spark, known, broadcast_bytes):
    values = ["the dog", "und der Hund", "le chien", "qqq", "", None, "123", "e", "chat the und", "the dog", "d", "katze"]
    rows = [("1" if i % 3 else None, v, "clash", 1) for i, v in enumerate(values)]
    docs = spark.createDataFrame(rows, "id string, text string, term string, _sums int")
    got = shortlang.detect_language_short(docs, known, "id", "text", carry=["text"], broadcast_bytes=broadcast_bytes)
    found = sorted(((r.id or "", r.text or "", r.lang_pred or "") for r in got.collect()))
    assert found == sorted(((r[0] or "", r[1] or "", plain_detect(r[1]) or "") for r in rows))


def test_very_long_text_is_decided(spark, known):
    docs = spark.createDataFrame([("1", "the cat " * 100_000)], "id string, text string")
    assert shortlang.detect_language_short(docs, known, "id", "text").first().lang_pred == "en"


def test_nothing_to_learn_or_to_detect(spark, known):
    with pytest.raises(ValueError):
        shortlang.profiles(spark.createDataFrame([(None, "x")], "lang string, text string"), "text", "lang")
    empty = spark.createDataFrame([], "id string, text string")
    assert shortlang.detect_language_short(empty, known, "id", "text").collect() == []


def test_accuracy_by_length_on_held_out_pieces(spark):
    """Comma pieces of documents that the profiles have not seen: few wrong, the shorter the more undecided."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    in_training = evaluate.in_training_part(F.col("doc_id"))
    known = shortlang.profiles(docs.where(in_training), "text", "lang")
    pieces = docs.where(~in_training).select("doc_id", "lang", F.explode(text.comma_pieces(F.col("text"))).alias("text"))
    found = shortlang.detect_language_short(pieces, known, "doc_id", "text", carry=["lang", "text"])
    size = F.when(F.length("text") < 20, "a under 20").when(F.length("text") < 50, "b under 50").otherwise("c longer")
    rows = found.groupBy(size.alias("size")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("lang_pred").isNull().cast("int")).alias("undecided"),
        F.avg(F.when(F.col("lang_pred").isNotNull(), (F.col("lang_pred") == F.col("lang")).cast("int"))).alias("right"),
    ).orderBy("size").collect()
    print(*rows, sep="\n")
    assert all(r.right > 0.97 for r in rows) and rows[-1].undecided < 0.05
    assert rows[0].undecided >= rows[-1].undecided and not math.isnan(rows[0].right)

import pytest
from pyspark.sql import functions as F

from tagloom.operators import langid, shortlang

SAMPLES = [
    ("the quick brown fox jumps over the lazy dog and then the other dogs", "en"),
    ("this is the house that was built with the money of the king", "en"),
    ("der schnelle braune fuchs springt über den faulen hund und dann", "de"),
    ("das ist das haus welches mit dem geld des königs gebaut wurde", "de"),
]


@pytest.fixture(scope="module")
def profiles(spark):
    return langid.language_profiles(spark.createDataFrame(SAMPLES, "text string, lang string"), "text", "lang")


def test_trigrams(spark):
    df = spark.createDataFrame([("Ab, 12 cdé!",), ("",), (None,), ("x",)], "text string")
    grams = [row.g for row in df.select(langid.trigrams(F.col("text")).alias("g")).collect()]
    assert grams == [[" ab", "ab ", " cd", "cdé", "dé "], [], None, [" x "]]


def test_detects_and_leaves_undecided(spark, profiles):
    rows = [
        (1, "the dogs and the other house of the king"), (2, "und das haus des königs mit dem hund"),
        (3, "12 34"), (4, None), (5, ""),
    ]
    docs = spark.createDataFrame(rows, "id int, text string")
    found = {r.id: r.lang_pred for r in langid.detect_language(docs, profiles, "id", "text").collect()}
    assert found == {1: "en", 2: "de", 3: None, 4: None, 5: None}


def test_whole_text_counts(spark, profiles):
    english, german = SAMPLES[0][0], " ".join(text for text, lang in SAMPLES if lang == "de")
    late = spark.createDataFrame([(1, english + " " + " ".join([german] * 50))], "id int, text string")
    assert langid.detect_language(late, profiles, "id", "text").first().lang_pred == "de"


def test_one_language(spark):
    only = langid.language_profiles(spark.createDataFrame(SAMPLES[:2], "text string, lang string"), "text", "lang")
    docs = spark.createDataFrame([(1, "whatever")], "id int, text string")
    assert langid.detect_language(docs, only, "id", "text").first().lang_pred == "en"


def test_agrees_with_the_given_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = docs.where("doc_id % 5 <> 0")
    learnt = langid.language_profiles(part, "text", "lang")
    found = langid.detect_language(docs.where("doc_id % 5 = 0"), learnt, "doc_id", "text")
    wrong = found.join(docs, "doc_id").where(~F.col("lang_pred").eqNullSafe(F.col("lang")))
    assert wrong.count() <= 2


def test_grams_of_counted_words_equal_grams_of_texts(spark):
    rows = [("The cat, the hat", "en"), ("the the cat", "en"), ("", "de"), (None, "de"), ("12 été \U0001d4d0b x", "fr"), ("none", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    for grams in (langid.trigrams, shortlang.grams):
        exploded = docs.where("lang IS NOT NULL").select(
            F.col("lang").alias("label"),
            F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), grams(F.col("text")))).alias("term"),
        )
        direct = exploded.groupBy("label", "term").count()
        counted = langid.gram_counts(docs, "text", "lang", grams)
        assert sorted(map(str, counted.collect())) == sorted(str(r).replace("count=", "n=") for r in direct.collect())
    counting = langid.gram_counts(docs, "text", "lang", langid.trigrams)._jdf.queryExecution().optimizedPlan().toString()
    assert counting.count("Aggregate") == 2

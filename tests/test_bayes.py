from math import exp

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer, StringIndexer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tagloom.functions.text import text_key, tokens
from tagloom.operators import bayes, features
from tagloom.plans import segments

QUERIES = [("q1", "bank budget"), ("q2", "racing chess"), ("q3", "unseen words"), ("q4", "")]
EXPECTED = {
    "q1": ([-4.790225, -20.277079, -20.394362], "Finance"),
    "q2": ([-20.398328, -6.459569, -20.394362], "Games"),
    "q3": ([-20.398328, -20.277079, -20.394362], "Games"),
    "q4": ([-10.657359, -10.596735, -11.001700], "Games"),
}


def tokenized(spark, rows):
    df = spark.createDataFrame(rows, "appId string, text string")
    return df.select("appId", tokens(F.col("text")).alias("tokens"))


def scores_of(df):
    return {row.appId: list(row.scores) for row in df.collect()}


def close(a, b, digits=1e-6):
    return a.keys() == b.keys() and all(
        abs(x - y) < digits for key in a for x, y in zip(a[key], b[key], strict=True)
    )


def test_fixture(spark, training):
    model = segments.train(training)
    assert model.labels == ["Finance", "Games", "Health"]
    scored = bayes.class_scores(tokenized(spark, QUERIES), model, "appId")
    rows = {row.appId: row for row in segments.predict(scored, model).collect()}
    for key, (scores, label) in EXPECTED.items():
        assert rows[key].scores == pytest.approx(scores, abs=1e-5)
        assert rows[key].predictedLabel == label


def test_label_order_equals_the_label_index(spark, training):
    rows = features.label_index(training, "segment").orderBy("label_idx").collect()
    assert [row.label for row in rows] == segments.train(training).labels


def english(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("appId"),
        F.col("text").alias("description"),
        F.col("source").alias("segment"),
    )
    return segments.prepare_training(docs)


def test_agrees_with_spark_ml(spark, sf_dir):
    empty = spark.createDataFrame([("e1", "", "src1", ""), ("e2", "", "src2", "")],
                                  "appId string, description string, segment string, clean_description string")
    docs = english(spark, sf_dir).unionByName(empty)
    words = Tokenizer(inputCol="clean_description", outputCol="tokens").transform(docs)
    vectors = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=1 << 20)
    fitted = vectors.fit(words)
    counted = fitted.transform(words)
    indexer = StringIndexer(inputCol="segment", outputCol="label").fit(counted)
    ml = NaiveBayes(smoothing=0.001).fit(indexer.transform(counted))
    expected = ml.transform(counted).select("appId", vector_to_array("rawPrediction").alias("scores"))

    model = bayes.fit(words, "segment", features=len(fitted.vocabulary))
    assert model.labels == list(indexer.labels)
    assert close(scores_of(bayes.class_scores(words, model, "appId")), scores_of(expected))


@pytest.mark.parametrize("broadcast_bytes", [1, 20_000, 200_000])
def test_split_join_equals_broadcast_join(spark, sf_dir, broadcast_bytes):
    prepared = english(spark, sf_dir).withColumn("tokens", tokens(F.col("clean_description")))
    model = segments.train(prepared)
    # A word that is rare in training and in every scored record, and a record without words.
    rare = model.term_rows().where("n = 1").orderBy("term").first().term
    docs = prepared.select("appId", F.concat("tokens", F.array(F.lit(rare))).alias("tokens"))
    nothing = spark.createDataFrame([("none", None), ("empty", [""])], "appId string, tokens array<string>")
    docs = docs.unionByName(nothing)
    whole = bayes.class_scores(docs, model, "appId")
    split = bayes.class_scores(docs, model, "appId", broadcast_bytes=broadcast_bytes)
    assert "_salt" in split._jdf.queryExecution().toString()
    assert "_salt" not in whole._jdf.queryExecution().toString()
    assert close(scores_of(whole), scores_of(split))


def test_independent_of_partitions(spark, training):
    one = segments.train(training.repartition(1))
    many = segments.train(training.repartition(8))
    docs = tokenized(spark, QUERIES)
    assert close(
        scores_of(bayes.class_scores(docs.repartition(1), one, "appId")),
        scores_of(bayes.class_scores(docs.repartition(8), many, "appId")),
        1e-9,
    )


def test_probabilities_sum_to_one(spark, training):
    model = bayes.fit(
        training.withColumn("tokens", tokens(F.col("clean_description"))), "segment", smoothing=1.0, features=20
    )
    rows = model.term_probabilities().where("label = 'Games'").collect()
    seen = sum(exp(row.log_prob) for row in rows)
    unseen = (20 - len(rows)) * exp(model.base(model.labels.index("Games")))
    assert seen + unseen == pytest.approx(1.0)
    assert sum(exp(model.prior(i)) for i in range(3)) == pytest.approx(1.0)


def test_save_and_load(spark, training, tmp_path):
    model = segments.train(training)
    model.save(str(tmp_path / "m"))
    loaded = bayes.BayesModel.load(spark, str(tmp_path / "m"))
    assert loaded.classes == model.classes
    docs = tokenized(spark, QUERIES)
    assert scores_of(bayes.class_scores(docs, loaded, "appId")) == scores_of(
        bayes.class_scores(docs, model, "appId")
    )


def test_many_classes(spark):
    rows = [(f"word{i}", f"class{i:03d}") for i in range(150)]
    docs = spark.createDataFrame(rows, "text string, segment string").select(
        F.col("text").alias("appId"), "segment", tokens(F.col("text")).alias("tokens")
    )
    model = bayes.fit(docs, "segment")
    predicted = segments.predict(bayes.class_scores(docs, model, "appId"), model)
    assert predicted.where(
        F.substring("predictedLabel", 6, 3).cast("int") != F.substring("appId", 5, 3).cast("int")
    ).count() == 0


def test_sums_as_rows_equal_sums_as_columns(spark, training, monkeypatch):
    docs = tokenized(spark, [*QUERIES, ("q5", None)])
    model = segments.train(training)
    columns = scores_of(bayes.class_scores(docs, model, "appId"))
    monkeypatch.setattr(bayes, "CLASS_COLUMNS", 0)
    for broadcast_bytes in (1, 1 << 20):
        rows = bayes.class_scores(docs, model, "appId", broadcast_bytes=broadcast_bytes)
        assert close(scores_of(rows), columns)


@pytest.mark.parametrize("broadcast_bytes", [1, 1 << 20])
def test_repeated_and_missing_ids(spark, training, broadcast_bytes):
    texts = ["bank", "chess", "chess", None, ""]
    rows = [(key, text) for key in ("1", None) for text in texts]
    model = segments.train(training)
    scored = bayes.class_scores(tokenized(spark, rows), model, "appId", broadcast_bytes=broadcast_bytes)
    got = sorted((row.appId or "", row.predictedLabel) for row in segments.predict(scored, model).collect())
    assert got == [(key, label) for key in ("", "1") for label in ["Finance"] + 4 * ["Games"]]


def test_batch_answers_every_record(spark, training):
    rows = [("1", "bank"), ("1", "chess"), (None, "bank"), (None, "caf\u00e9")]
    records = spark.createDataFrame(rows, "appId string, description string")
    got = segments.batch_segments(records, segments.train(training)).collect()
    assert sorted((row.appId or "", row.predictedLabelFinal) for row in got) == [
        ("", "Finance"), ("", "Not supported language"), ("1", "Finance"), ("1", "Games"),
    ]
    keyed = records.select("*", *text_key(F.col("description")))
    detected = keyed.withColumn("lang_pred", F.when(F.col("description") == "bank", "en"))
    got = segments.batch_segments(records, segments.train(training), detected=detected).collect()
    assert sorted((row.appId or "", row.predictedLabelFinal) for row in got) == [
        ("", "Finance"), ("", "Not supported language"), ("1", "Finance"), ("1", "Not supported language"),
    ]


def test_refuses_nothing(training):
    with pytest.raises(ValueError):
        segments.train(training.where("false"))


def test_rows_without_label_or_text(spark):
    rows = [("bank", "Finance"), (None, "Finance"), ("game", "Games"), ("lost", None)]
    docs = spark.createDataFrame(rows, "text string, segment string").select(
        "segment", tokens(F.col("text")).alias("tokens")
    )
    stats = {s.label: (s.docs, s.tokens) for s in bayes.fit(docs, "segment").classes}
    assert stats == {"Finance": (2, 1), "Games": (1, 1)}


def _words_of(spark, texts):
    docs = tokenized(spark, texts).select(
        "appId",
        *text_key(F.col("tokens"), "_words"),
        F.size("tokens").alias("_length"),
        F.col("tokens").alias("_tokens"),
    )
    return bayes._words(docs, ["appId", "_words_a", "_words_b", "_length"])


@pytest.fixture
def monkeypatch_conf():
    kept = {}

    def put(spark, values):
        for key, value in values.items():
            kept.setdefault(key, (spark, spark.conf.get(key)))
            spark.conf.set(key, value)

    yield put
    for key, (spark, value) in kept.items():
        spark.conf.set(key, value)


def test_one_common_word_fills_no_task(spark, training, monkeypatch_conf):
    texts = [(f"r{i}", " ".join(["budget"] * 5)) for i in range(2000)]
    words = _words_of(spark, texts)
    model = segments.train(training)
    weights = model.term_weights()
    heavy = bayes.heavy_words(words, 100, 0)
    groups = bayes.GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [(r.term, r.salts) for r in heavy.collect()] == [("budget", groups)]
    # As on a large table: nothing small enough to broadcast, no partitions joined.
    monkeypatch_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"})
    far = bayes.far_rows(words, weights, heavy, "appId")
    assert far.count() == 10_000
    dealt = [r["count"] for r in far.groupBy("_first", F.spark_partition_id().alias("p")).count().collect()]
    assert len(dealt) > 1 and max(dealt) <= 3 * sorted(dealt)[len(dealt) // 2]


def test_heavy_words_that_fit_are_broadcast(spark, training):
    words = _words_of(spark, [(str(i), "bank bank chess w%d" % i) for i in range(500)])
    heavy = {r.term: r.salts for r in bayes.heavy_words(words, 100, 150).collect()}
    assert heavy["bank"] == 0 and heavy["chess"] > 1 and len(heavy) == 2
    far = bayes.far_rows(words, segments.train(training).term_weights(), bayes.heavy_words(words, 100, 150), "appId")
    # Unknown words are ruled out, the broadcast word is not shuffled.
    assert {r.term for r in far.collect()} == {"chess"}


def test_no_words_at_all(spark, training):
    words = _words_of(spark, [("a", "x")]).where("false")
    assert bayes.heavy_words(words, 100, 0).collect() == []


@pytest.mark.parametrize("broadcast_bytes", [1, 1 << 30])
def test_postings_equal_dense_weights(spark, broadcast_bytes, monkeypatch):
    labels = 230
    rows = [(f"c{i % labels:03d}", f"w{i % 7} w{i % 31} only{i % labels} all") for i in range(900)]
    docs = spark.createDataFrame(rows, "segment string, text string").select(
        "segment", tokens(F.col("text")).alias("tokens")
    )
    model = bayes.fit(docs, "segment")
    texts = [("a", "w1 w1 all"), ("b", "only7 only7 w3"), ("c", "unknown"), ("d", ""), ("e", None), ("a", "w1 w1 all"), (None, "all")]
    scored = tokenized(spark, texts)

    def of(df):
        return sorted((r.appId or "", [round(x, 6) for x in r.scores]) for r in df.collect())

    sparse = of(bayes.class_scores(scored, model, "appId", broadcast_bytes=broadcast_bytes))
    monkeypatch.setattr(bayes, "CLASS_COLUMNS", labels)
    assert sparse == of(bayes.class_scores(scored, model, "appId"))


def test_rows_follow_the_entries_of_the_model(spark):
    docs = spark.createDataFrame([(f"c{i}", [f"w{i}", "all"]) for i in range(300)], "segment string, tokens array<string>")
    model = bayes.fit(docs, "segment")
    sizes = {r.term: len(r.weights) for r in model.term_postings().collect()}
    assert sizes.pop("all") == 300 and set(sizes.values()) == {1}


def test_commonest_terms_of_a_larger_model_are_broadcast(spark):
    uses = {f"w{i:02d}": i + 1 for i in range(60)}
    rows = [("Games", [word] * n) for word, n in uses.items()] + [("Finance", ["w00"])]
    model = bayes.fit(spark.createDataFrame(rows, "segment string, tokens array<string>"), "segment")
    weights = model.term_weights()
    row = bayes.ROW_BYTES + 2 * 8 + 3
    assert bayes.common_uses(weights, 10 * row, False, 2) == 51
    assert bayes.common_uses(weights, 1, False, 2) > bayes.COMMON_USES
    assert bayes.common_uses(weights, 1000 * row, False, 2) == 2
    docs = spark.createDataFrame([("a", ["w59", "w59", "w00", "x"]), ("b", ["w58"])], "appId string, tokens array<string>")
    keyed = docs.select("appId", *text_key(F.col("tokens"), "_words"), F.size("tokens").alias("_length"), F.col("tokens").alias("_tokens"))
    words = bayes._words(keyed, ["appId", "_words_a", "_words_b", "_length"])
    hits = bayes._split_join(words, weights, "appId", 20 * row, False, 2)
    # Both common words meet their weights where they stand, once each, and every word marks its record once.
    assert hits.where("term = 'w59' AND weights IS NOT NULL").count() == 2
    assert hits.where("_first").count() == 2
    whole, split = bayes.class_scores(docs, model, "appId"), bayes.class_scores(docs, model, "appId", broadcast_bytes=20 * row)
    assert close(scores_of(whole), scores_of(split))


def test_records_cleaned_once_are_answered_alike(spark):
    rows = [("1", "Banks, lending", "Finance"), ("2", None, "Games"), ("3", "café bank", "Games"), ("1", "", "Games")]
    records = spark.createDataFrame(rows, "appId string, description string, segment string")
    model = segments.train(segments.prepare_training(records))
    for only_english in (False, True):
        once = segments.preprocess_records(records, only_english=only_english)
        assert segments.train(once.where("english")).classes == model.classes
        for how in ("override", "drop"):
            plain = segments.batch_segments(records, model, non_english=how)
            found = segments.batch_segments(once, model, non_english=how, preprocessed=True)
            assert sorted(found.collect()) == sorted(plain.collect())

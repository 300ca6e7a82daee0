import pytest
from pyspark.sql import functions as F

from tagloom.functions import ranking
from tagloom.functions.text import text_key
from tagloom.plans import mllib, segments

RECORDS = [
    ("1", "Bank budget!"), ("2", "Racing chess"), ("3", "café bank"), ("4", None), ("5", ""), ("6", "the"),
]


@pytest.fixture(scope="module")
def model(training):
    return segments.train(training)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "appId string, description string")


def as_dict(df):
    rows = df.collect()
    result = {row[0]: row[1] for row in rows}
    assert len(result) == len(rows)
    return result


def test_override(records, model):
    # "Racing" has the base form "race", which training has not seen.
    assert as_dict(segments.batch_segments(records, model)) == {
        "1": "Finance", "2": "Games", "3": "Not supported language",
        "4": "Not supported language", "5": "Games", "6": "Games",
    }


def test_drop(records, model):
    answered = as_dict(segments.batch_segments(records, model, non_english="drop"))
    assert set(answered) == {"1", "2", "5", "6"}
    with pytest.raises(ValueError):
        segments.batch_segments(records, model, non_english="keep")


def test_detected_language(spark, records, model):
    detected = spark.createDataFrame(
        [("1", "en"), ("2", "fr"), ("3", "en"), ("4", None)], "appId string, lang_pred string"
    )
    answered = as_dict(segments.batch_segments(records, model, detected=detected))
    unsupported = "Not supported language"
    assert answered == {"1": "Finance", "2": unsupported, "3": "Finance", "4": unsupported,
                        "5": unsupported, "6": unsupported}
    dropped = segments.batch_segments(records, model, detected=detected, non_english="drop")
    assert set(as_dict(dropped)) == {"1", "3"}


def test_top_k(records, model):
    top = segments.top_segments(records, model, 2)
    rows = {row.appId: row for row in top.collect()}
    assert rows["1"].labels == ["Finance", "Games"]
    assert rows["1"].topXPredictions == "Finance Games"
    # No override unless asked for.
    assert rows["3"].labels[0] == "Finance"
    overridden = {r.appId: r.labels for r in segments.top_segments(records, model, 2, override=True).collect()}
    assert overridden["3"] == ["Not supported language"]


@pytest.mark.parametrize("k,expected", [(99, 3), (3, 3), (1, 1), (0, 0), (-1, 0)])
def test_top_k_bounds(records, model, k, expected):
    assert {len(row.labels) for row in segments.top_segments(records, model, k).collect()} == {expected}


def test_top_one_is_the_prediction_without_ties(records, model):
    scored = segments.score_records(records, model)
    first = ranking.top_labels(F.col("scores"), model.labels, 1)[0]
    assert segments.predict(scored, model).where(first != F.col("predictedLabel")).count() == 0


def test_ties(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0000000001],)], "scores array<double>")
    row = df.select(
        ranking.best_index(F.col("scores")).alias("best"),
        ranking.top_labels(F.col("scores"), ["a", "b", "c"], 3).alias("top"),
    ).first()
    assert row.best == 1
    assert row.top == ["c", "b", "a"]


def test_raw_scores_and_lists(records, model, training):
    scored = segments.score_records(records, model)
    assert segments.raw_scores(scored, model).count() == len(RECORDS) * 3
    assert {r.segment for r in segments.all_segments(training).collect()} == {"Finance", "Games", "Health"}
    assert segments.segments_text(training).first().segments == "[Finance,Games,Health]"
    spread = segments.segment_distribution(segments.batch_segments(records, model))
    assert as_dict(spread) == {"Finance": 1, "Games": 3, "Not supported language": 2}


def test_prepare_training_pieces(spark):
    df = spark.createDataFrame(
        [("1", "the,big game,,"), ("2", "ñ"), ("3", None), ("4", ",,")], "appId string, description string"
    )
    assert as_dict(segments.prepare_training(df).select("appId", "clean_description")) == {
        "1": "big game", "4": ""
    }
    dropped = segments.prepare_training(df, drop_stop_word_pieces=True, stop_words=[])
    assert as_dict(dropped.select("appId", "clean_description"))["1"] == "big game"


def test_ml_pipeline_agrees_on_the_fixture(spark, training, model, tmp_path):
    from pyspark.ml import PipelineModel

    fitted = mllib.fit_hashed_bayes(training)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    queries = spark.createDataFrame(
        [("q1", "bank budget", ""), ("q2", "racing chess", ""), ("q3", "unseen words", "")],
        "appId string, clean_description string, segment string",
    )
    rows = {r.appId: r for r in mllib.top_labels_of(loaded, queries, 2).collect()}
    assert [rows[q].predictedLabel for q in ("q1", "q2", "q3")] == ["Finance", "Games", "Games"]
    assert rows["q2"].labels[0] == "Games"


def test_one_vs_rest(training):
    fitted = mllib.fit_one_vs_rest(training)
    assert mllib.predict(fitted, training).where(F.col("predictedLabel").isNull()).count() == 0


def test_hashed_feature_sizes(spark):
    docs = spark.createDataFrame([("1", ["a", "b", "a"])], "appId string, tokens array<string>")
    assert tuple(mllib.feature_sizes(mllib.hashed_features(docs), "appId").first()) == ("1", 2, 3)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
@pytest.mark.parametrize("keyed", [True, False])
def test_training_rows_by_detected_language(spark, broadcast_bytes, keyed):
    rows = [("1", "the cats", "A"), ("2", "die Katzen", "A"), (None, "the dogs", "B"), (None, "der Hund", "B"), ("3", None, "C")]
    records = spark.createDataFrame(rows, "appId string, description string, segment string")
    english = F.col("description").startswith("the")
    detected = records.select("appId", *(text_key(F.col("description")) if keyed else []), F.when(english, "en").alias("lang_pred"))
    if not keyed:
        records, detected = records.where("appId is not null"), detected.where("appId is not null")
    got = segments.prepare_training(records, detected=detected, broadcast_bytes=broadcast_bytes)
    assert got.columns == ["appId", "description", "segment", "clean_description"]
    assert sorted(r.description for r in got.collect()) == (["the cats", "the dogs"] if keyed else ["the cats"])

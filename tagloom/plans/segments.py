"""The user-level queries: train, classify, rank, list and evaluate segments of app records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.patterns import SMOOTHING, UNSUPPORTED_LANGUAGE
from tagloom.functions.ranking import best_index, label_at, ranked, top_labels
from tagloom.functions.text import (
    comma_pieces,
    default_stop_words,
    drop_stop_pieces,
    is_ascii,
    preprocess_text,
    preprocessed_tokens,
    text_key,
    tokens,
)
from tagloom.operators import bayes
from tagloom.operators.bloom import bloom_filter
from tagloom.shared import BROADCAST_BYTES, broadcast_size, materialize


def is_english(description: Column) -> Column:
    """The English test on characters; never NULL, a missing description is not English."""
    return F.coalesce(is_ascii(description), F.lit(False))


def override_non_english(label: Column, english: Column) -> Column:
    return F.when(english, label).otherwise(F.lit(UNSUPPORTED_LANGUAGE))


def _keys(detected: DataFrame) -> list[str]:
    """The text keys of ``detected``; without them its ids must name one record each."""
    return [key for key in ("_key_a", "_key_b") if key in detected.columns]


def _same_record(id_col: str, keys: Sequence[str]) -> Column:
    """Rows of ``r`` and ``d`` with the same id, or none, and the same text."""
    same = F.col(f"r.{id_col}").eqNullSafe(F.col(f"d.{id_col}"))
    for key in keys:
        same = same & (F.col(f"r.{key}") == F.col(f"d.{key}"))
    return same


def prepare_training(
    records: DataFrame,
    text_col: str = "description",
    stop_words: Sequence[str] | None = None,
    drop_stop_word_pieces: bool = False,
    detected: DataFrame | None = None,
    id_col: str = "appId",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """English records with ``clean_description``.

    ``drop_stop_word_pieces`` first drops comma-separated pieces that are a stop word.
    Without it splitting and joining on commas is left out: cleaning turns commas into
    blanks. With ``detected`` (id, lang_pred, and where ids repeat the text keys) the detected language of the
    record decides what is English instead of the characters. The English records' keys are broadcast if they
    fit; of more, a Bloom filter of them drops the other texts before the rest is shuffled.
    """
    stop_words = default_stop_words() if stop_words is None else stop_words
    if detected is None:
        english = records.where(is_english(F.col(text_col)))
    else:
        keys = _keys(detected)
        keyed = records.select("*", *text_key(F.col(text_col)))
        chosen = materialize(
            detected.where(F.col("lang_pred") == "en").select(id_col, *keys).distinct(), "english-records"
        )
        names = [name for name, kind in chosen.dtypes if kind == "string"]
        if broadcast_size(chosen, *names) <= broadcast_bytes:
            chosen = F.broadcast(chosen)
        elif keys:
            keyed = keyed.where(bloom_filter(chosen, "_key_a").may_contain(F.col("_key_a")))
        same = _same_record(id_col, keys)
        english = keyed.alias("r").join(chosen.alias("d"), same, "left_semi").drop("_key_a", "_key_b")
    text = F.col(text_col)
    if drop_stop_word_pieces:
        pieces = drop_stop_pieces(comma_pieces(text), default_stop_words())
        text = F.concat_ws(",", pieces)
    return english.withColumn("clean_description", preprocess_text(text, stop_words))


def preprocess_records(
    records: DataFrame,
    text_col: str = "description",
    stop_words: Sequence[str] | None = None,
    only_english: bool = False,
) -> DataFrame:
    """``records`` with ``english`` and ``clean_description`` in place of the text, written once.

    For records that a model is both trained on and applied to: texts are cleaned once. With
    ``only_english`` the clean text of the other records is NULL.
    """
    stop_words = default_stop_words() if stop_words is None else stop_words
    english, clean = is_english(F.col(text_col)), preprocess_text(F.col(text_col), stop_words)
    others = [name for name in records.columns if name != text_col]
    return materialize(
        records.select(
            *others,
            english.alias("english"),
            (F.when(english, clean) if only_english else clean).alias("clean_description"),
        ),
        "preprocessed",
    )


def train(
    prepared: DataFrame, segment_col: str = "segment", smoothing: float = SMOOTHING
) -> bayes.BayesModel:
    labelled = prepared.select(segment_col, tokens(F.col("clean_description")).alias("tokens"))
    return bayes.fit(labelled, segment_col, "tokens", smoothing)


def score_records(
    records: DataFrame,
    model: bayes.BayesModel,
    id_col: str = "appId",
    text_col: str = "description",
    stop_words: Sequence[str] | None = None,
    only_english: bool = False,
    carry: Sequence[str] = (),
    preprocessed: bool = False,
) -> DataFrame:
    """``(id, *carry, english, scores)``; one row per record, whether or not ids repeat.

    ``only_english`` spares the text work on records whose answer will be overridden. ``preprocessed`` says
    that the records come from ``preprocess_records``.
    """
    if preprocessed:
        words, english = F.split("clean_description", " "), F.col("english")
    else:
        stop_words = default_stop_words() if stop_words is None else stop_words
        words = preprocessed_tokens(F.col(text_col), stop_words)
        english = is_english(F.col(text_col))
    if only_english:
        words = F.when(english, words)
    tokenized = records.select(id_col, *carry, english.alias("english"), words.alias("tokens"))
    return bayes.class_scores(tokenized, model, id_col, carry=[*carry, "english"], written=preprocessed)


def predict(scored: DataFrame, model: bayes.BayesModel) -> DataFrame:
    """Adds ``label_idx`` and ``predictedLabel`` to scored records."""
    return scored.withColumn("label_idx", best_index(F.col("scores"))).withColumn(
        "predictedLabel", label_at(F.col("label_idx"), model.labels)
    )


def batch_segments(
    records: DataFrame,
    model: bayes.BayesModel,
    id_col: str = "appId",
    text_col: str = "description",
    stop_words: Sequence[str] | None = None,
    non_english: str = "override",
    detected: DataFrame | None = None,
    preprocessed: bool = False,
) -> DataFrame:
    """``(id, predictedLabelFinal)``: the segment of each record.

    ``non_english="override"`` answers such records with a message, ``"drop"`` leaves them
    out. With ``detected`` (id, lang_pred, and where ids repeat the text keys) the detected language decides instead
    of the characters; it is joined to the scores, one small row per record, not to the texts. ``preprocessed``
    records come from ``preprocess_records``; they then bring the text keys themselves.
    """
    if non_english not in ("override", "drop"):
        raise ValueError("non_english is 'override' or 'drop'")
    by_characters = detected is None
    if by_characters and non_english == "drop":
        records = records.where(F.col("english") if preprocessed else is_english(F.col(text_col)))
    carry = () if by_characters else _keys(detected)
    if carry and not preprocessed:
        records = records.select(id_col, text_col, *text_key(F.col(text_col)))
    scored = score_records(
        records, model, id_col, text_col, stop_words, only_english=by_characters, carry=carry, preprocessed=preprocessed
    )
    answered = predict(scored, model)
    if not by_characters:
        by_detector = F.coalesce(F.col("lang_pred") == "en", F.lit(False))
        # Records that agree in id and text have the same language.
        found = detected.select(id_col, *carry, by_detector.alias("english")).distinct()
        answered = (
            answered.drop("english")
            .alias("r")
            .join(found.alias("d"), _same_record(id_col, carry), "left")
            .select(f"r.{id_col}", "r.predictedLabel", F.coalesce("d.english", F.lit(False)).alias("english"))
        )
        if non_english == "drop":
            answered = answered.where("english")
    final = override_non_english(F.col("predictedLabel"), F.col("english"))
    return answered.select(id_col, final.alias("predictedLabelFinal"))


def top_segments(
    records: DataFrame,
    model: bayes.BayesModel,
    k: int,
    id_col: str = "appId",
    text_col: str = "description",
    stop_words: Sequence[str] | None = None,
    override: bool = False,
    preprocessed: bool = False,
) -> DataFrame:
    """``(id, labels, topXPredictions)``: the ``k`` best labels, as an array and blank-joined.

    Equal scores put the higher label index first, unlike the single prediction, which
    takes the lower one. The language override is off unless asked for.
    """
    scored = score_records(records, model, id_col, text_col, stop_words, only_english=override, preprocessed=preprocessed)
    best = top_labels(F.col("scores"), model.labels, k)
    if override:
        best = F.when(F.col("english"), best).otherwise(F.array(F.lit(UNSUPPORTED_LANGUAGE)))
    return scored.select(id_col, best.alias("labels")).withColumn(
        "topXPredictions", F.array_join("labels", " ")
    )


def raw_scores(scored: DataFrame, model: bayes.BayesModel, id_col: str = "appId") -> DataFrame:
    """``(id, score, label_idx, label)``, one row per record and class."""
    return scored.select(id_col, F.inline(ranked(F.col("scores"), model.labels)))


def all_segments(training: DataFrame, segment_col: str = "segment") -> DataFrame:
    return training.select(segment_col).distinct()


def segments_text(training: DataFrame, segment_col: str = "segment") -> DataFrame:
    """The distinct segments as one text ``[a,b,...]``, sorted; a class list is short."""
    segments = F.array_sort(F.collect_set(segment_col))
    return training.agg(
        F.concat(F.lit("["), F.array_join(segments, ","), F.lit("]")).alias("segments")
    )


def segment_distribution(answered: DataFrame, column: str = "predictedLabelFinal") -> DataFrame:
    return answered.groupBy(column).agg(F.count(F.lit(1)).alias("n"))

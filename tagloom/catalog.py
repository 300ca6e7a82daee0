"""Registered queries: each operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import patterns, ranking, text
from tagloom.functions.lemma import lemma
from tagloom.operators import (
    bayes,
    evaluate,
    features,
    hashing,
    langid,
    lexicon,
    onevsrest,
    shortlang,
    taglemma,
    tagger,
)
from tagloom.plans import corpus, mllib, segments
from tagloom.schema import APP_RECORD, CORRUPT_COLUMN, TRAINING_RECORD
from tagloom.shared import materialize, new_path
from tagloom.sources import folders, jsonarray, readers, writers
from tagloom.streaming import report, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP_K = 3


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    return readers.read_table(spark, f"{sf_dir}/{name}.parquet", key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


def app_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as app records; the source plays the segment."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("appId"),
        F.col("text").alias("description"),
        F.col("source").alias("segment"),
    )


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.prepare_training(app_records(spark, sf_dir))


def per_document(expression: Callable[[], object], out: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", expression().alias(out))

    return query


# --- sources and sinks -------------------------------------------------------------------


@register
def ingest_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as delimited files and read back by the names in their header."""
    records = documents(spark, sf_dir).select(
        F.col("source").alias("segment"),
        text.strip_control_characters(F.col("text")).alias("description"),
        F.col("n_chars").alias("size"),
        F.col("doc_id").cast("string").alias("appId"),
        F.col("source").alias("appName"),
        F.col("lang").alias("package"),
    )
    path = new_path(spark, "delimited")
    writers.write_delimited(records, path)
    return readers.read_delimited(spark, path).select(*TRAINING_RECORD.names)


@register
def ingest_json_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a payload of two records, with raw line breaks between the parts."""
    appid = F.col("doc_id").cast("string")
    full = F.to_json(
        F.struct(
            appid.alias("appId"), F.col("text").alias("description"), F.col("source").alias("segment")
        )
    )
    bare = F.to_json(F.struct(F.concat(appid, F.lit("-bare")).alias("appId")))
    payloads = documents(spark, sf_dir).select(
        F.concat(F.lit("[\n"), full, F.lit(",\r\n\t"), bare, F.lit("\n]")).alias("payload")
    )
    return readers.parse_payloads(payloads, "payload").select(*TRAINING_RECORD.names)


@register
def ingest_json_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of each document; those of odd ids end too early and are kept as they are."""
    appid = F.col("doc_id").cast("string")
    record = F.to_json(F.struct(appid.alias("appId"), F.col("source").alias("segment")))
    end = F.when(F.col("doc_id") % 2 == 0, "]").otherwise(F.lit(',{"appId":"x"'))
    payloads = documents(spark, sf_dir).select(F.concat(F.lit("["), record, end).alias("payload"))
    return readers.parse_payloads(payloads, "payload").select(
        "appId", "segment", F.col(CORRUPT_COLUMN).alias("corrupt")
    )


@register
def ingest_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back with the declared schema."""
    path = new_path(spark, "json")
    records = app_records(spark, sf_dir).withColumn("appName", F.col("segment"))
    writers.write_json(records, path, "appId", "appName", "description")
    return readers.read_json_records(spark, path, APP_RECORD).select(*APP_RECORD.names)


# Files that the documents are written to, each one array: at least so many, and one for so many bytes of records.
ARRAYS = 4
ARRAY_BYTES = 64 * 1024 * 1024


@register
def ingest_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of one JSON array each and read back in ranges."""
    records = app_records(spark, sf_dir)
    size = records.agg(F.sum(F.octet_length("description")).alias("size")).first().size or 0
    arrays = max(ARRAYS, -(-size // ARRAY_BYTES))
    part = F.pmod(F.xxhash64("appId"), F.lit(arrays)).cast("int").alias("part")
    body = F.concat(F.lit(","), F.to_json(F.struct("appId", "description", F.col("segment").alias("appName"))))
    rows = records.select(part, F.lit(1).alias("place"), body.alias("value"))
    parts = spark.range(arrays).select(F.col("id").cast("int").alias("part"))
    for place, value in ((0, '[{"package":"first"}'), (2, "]")):
        rows = rows.unionByName(parts.select("part", F.lit(place).alias("place"), F.lit(value).alias("value")))
    path = new_path(spark, "json-arrays")
    dealt = rows.repartitionById(arrays, F.col("part")).sortWithinPartitions("part", "place")
    dealt.select("part", "value").write.partitionBy("part").text(path)
    found = jsonarray.read_json_array(spark, path)
    return found.where(F.col("package").isNull()).select(*APP_RECORD.names)


@register
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned text of every HTML page."""
    return corpus.cleaned(table(spark, sf_dir, "pages", "page_id"), "page_id", "html")


@register
def clean_folder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of its own, cleaned into a table twice: the second run replaces the first."""
    source, target = new_path(spark, "pages"), new_path(spark, "cleaned-pages")
    pages = table(spark, sf_dir, "pages").where(F.col("html").isNotNull())
    folders.write_files(pages, source, "page_id", "html")
    for _ in range(2):
        corpus.clean_folder_parts(spark, source, target, "*.txt", recursive=True)
    page_id = F.regexp_extract("file", r"page_id=(-?[0-9]+)", 1).try_cast("long").alias("page_id")
    return spark.read.parquet(target).select(page_id, "cleaned")


@register
def batch_segments_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.json_rows(batch_segments(spark, sf_dir), "appId", "predictedLabelFinal")


@register
def nb_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, save, load, and classify with the loaded model."""
    path = new_path(spark, "bayes-model")
    segments.train(prepared(spark, sf_dir)).save(path)
    model = bayes.BayesModel.load(spark, path)
    return segments.batch_segments(app_records(spark, sf_dir), model)


# --- predicates and overrides ------------------------------------------------------------


@register
def filter_ascii_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.where(segments.is_english(F.col("text"))).select("doc_id", "lang", "n_chars")


@register
def filter_detected_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(spark, sf_dir).where(F.col("lang_pred") == "en")


@register
def filter_allowed_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pieces (split at commas) that consist of allowed characters only."""
    pieces = documents(spark, sf_dir).select(
        "doc_id", F.posexplode(text.comma_pieces(F.col("text"))).alias("position", "piece")
    )
    return pieces.where(text.has_allowed_characters(F.col("piece")))


@register
def override_non_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    final = segments.override_non_english(F.col("source"), segments.is_english(F.col("text")))
    return docs.select("doc_id", final.alias("final_label"))


# --- text --------------------------------------------------------------------------------

QUERIES["text_lower"] = per_document(lambda: F.lower("text"), "lowered")
QUERIES["strip_urls"] = per_document(lambda: text.clean_up_to(F.col("text"), "urls"), "stripped")
QUERIES["strip_punctuation"] = per_document(
    lambda: text.clean_up_to(F.col("text"), "punctuation"), "stripped"
)
QUERIES["strip_digits"] = per_document(lambda: text.clean_up_to(F.col("text"), "digits"), "stripped")
QUERIES["strip_small_words"] = per_document(
    lambda: text.clean_up_to(F.col("text"), "small_words"), "stripped"
)
QUERIES["strip_alphanumerics"] = per_document(
    lambda: text.clean_up_to(F.col("text"), "alphanumerics"), "stripped"
)
QUERIES["collapse_whitespace"] = per_document(
    lambda: text.clean_up_to(F.col("text"), "white_space"), "stripped"
)
QUERIES["clean_text"] = per_document(
    lambda: text.clean_text(F.col("text"), text.default_stop_words()), "cleaned"
)
QUERIES["preprocess_text"] = per_document(
    lambda: text.preprocess_text(F.col("text"), text.default_stop_words()), "preprocessed"
)
QUERIES["strip_non_ascii"] = per_document(lambda: text.strip_non_ascii(F.col("text")), "stripped")
QUERIES["strip_control_chars"] = per_document(
    lambda: text.strip_control_characters(F.col("text")), "stripped"
)


@register
def remove_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single patterns on the raw text, by name."""
    raw = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id",
        text.remove_pattern(raw, "urls").alias("without_urls"),
        text.remove_pattern(raw, "punctuation").alias("without_punctuation"),
        text.remove_pattern(raw, "white_space").alias("without_white_space"),
    )


@register
def remove_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact stop words out of the lower-cased text, otherwise left as it is."""
    stop_words = text.default_stop_words()
    return documents(spark, sf_dir).select(
        "doc_id", text.drop_words(F.lower("text"), stop_words).alias("kept")
    )


@register
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(text.comma_pieces(F.col("text"))).alias("position", "piece")
    )


@register
def stopword_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma pieces without those that are a stop word, joined again."""
    pieces = text.drop_stop_pieces(text.comma_pieces(F.col("text")), text.default_stop_words())
    return documents(spark, sf_dir).select("doc_id", F.concat_ws(",", pieces).alias("joined"))


@register
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(text.clean_text(F.col("text"), text.default_stop_words()))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(words).alias("n_tokens"), F.array_join(words, "|").alias("tokens")
    )


# --- words against tables ----------------------------------------------------------------


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.clean_text(F.col("text"), text.default_stop_words())
    return documents(spark, sf_dir).select("doc_id", "lang", "source", cleaned.alias("cleaned"))


def _cleaned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, for queries that make a lexicon of the texts and apply it to them."""
    return materialize(_cleaned(spark, sf_dir), "cleaned")


def _commonest(docs: DataFrame, tag: Column, least_letters: int) -> DataFrame:
    """``(word, tag)`` of the words of so many letters: the tag most of their uses have."""
    words = text.explode_once(text.tokens(F.col("cleaned"))).alias("word")
    tagged = docs.select(words, tag.alias("tag")).where(F.length("word") >= least_letters)
    return lexicon.most_frequent_tags(tagged, "word", "tag")


@register
def lemmatize_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base form of every distinct token of the corpus."""
    tokenized = _cleaned(spark, sf_dir).select(text.tokens(F.col("cleaned")).alias("tokens"))
    return lexicon.vocabulary_lemmas(tokenized)


@register
def lookup_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words replaced through a dictionary: longer words by the source they occur in most often."""
    docs = _cleaned_once(spark, sf_dir)
    entries = _commonest(docs, F.col("source"), 6).withColumnRenamed("tag", "value")
    return lexicon.replace_words(docs, "doc_id", "cleaned", entries)


@register
def annotate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with the tag it carries most often in the corpus, here the language of its text.

    Words of fewer than five letters are not in the lexicon and get the default tag.
    """
    docs = _cleaned_once(spark, sf_dir)
    tags = _commonest(docs, F.upper("lang"), 5)
    return lexicon.annotate_words(docs, "doc_id", "cleaned", tags, "XX")


@register
def lemmatize_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base forms from a lexicon before the rules; here it lists the source of longer words."""
    docs = _cleaned_once(spark, sf_dir)
    listed = _commonest(docs, F.col("source"), 6).withColumnRenamed("tag", "lemma")
    return lexicon.lemmatize_by_lexicon(docs, "doc_id", "cleaned", listed)


@register
def drop_listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a listed table dropped: here those that stand in at least a tenth of the documents."""
    docs = _cleaned_once(spark, sf_dir)
    words = docs.select(text.explode_once(F.array_distinct(text.tokens(F.col("cleaned")))).alias("word"))
    least = docs.count() / 10
    listed = words.groupBy("word").count().where(F.col("count") >= least)
    return lexicon.drop_words_by_table(docs, "doc_id", "cleaned", listed)


def _in_training(docs: DataFrame) -> DataFrame:
    return docs.where(evaluate.in_training_part(F.col("doc_id")))


@register
def tag_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest tags of every word in its context, here languages, learnt from the larger part."""
    docs = _cleaned_once(spark, sf_dir)
    words = F.split("cleaned", " ")
    model = tagger.fit(tagger.tagged_rows(_in_training(docs), words, F.upper("lang")))
    return tagger.tag_sequence(docs, model, "doc_id", "cleaned")


def _tagged_words(docs: DataFrame) -> DataFrame:
    """Distinct ``(word, tag)`` of cleaned texts."""
    words = text.explode_once(F.array_distinct(text.tokens(F.col("cleaned")))).alias("word")
    return docs.select(words, F.upper("lang").alias("tag")).where(F.col("word") != "").distinct()


@register
def lemmatize_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base forms of all words by tag, learnt from the listed part: English words by the rules, others as they are."""
    words = materialize(_tagged_words(_cleaned(spark, sf_dir)), "tagged-words")
    listed = words.where(evaluate.in_training_part(F.col("word"))).withColumn(
        "lemma", F.when(F.col("tag") == "EN", lemma(F.col("word"))).otherwise(F.col("word"))
    )
    return taglemma.lemmatize_tagged(words, taglemma.learn(listed))


@register
def drop_words_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a word-list file dropped; the file lists the words of the benchmark items, one a line."""
    items = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word"))
    path = new_path(spark, "word-list")
    items.distinct().write.text(path)
    listed = readers.read_word_list(spark, path)
    return lexicon.drop_words_by_table(_cleaned(spark, sf_dir), "doc_id", "cleaned", listed)


@register
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = langid.language_profiles(documents(spark, sf_dir), "text", "lang")
    return profiles.term_rows().select(
        F.col("label").alias("lang"), F.col("term").alias("ngram"), "n"
    )


@register
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.language_profiles(docs, "text", "lang")
    return langid.detect_language(docs, profiles, "doc_id", "text")


@register
def detect_language_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every turn of the conversations, by grams learnt from the documents."""
    known = shortlang.profiles(documents(spark, sf_dir), "text", "lang")
    turns = table(spark, sf_dir, "conversations", "conv_id")
    return shortlang.detect_language_short(turns, known, "conv_id", "text", carry=["turn"])


# --- features and models -----------------------------------------------------------------


@register
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = app_records(spark, sf_dir).where(segments.is_english(F.col("description")))
    return features.label_index(english, "segment")


@register
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.tokens(F.col("clean_description"))
    return features.term_counts(prepared(spark, sf_dir).withColumn("tokens", words), "appId")


@register
def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed counts of every English document, as ``bucket:n`` in bucket order."""
    words = text.tokens(F.col("clean_description"))
    docs = prepared(spark, sf_dir).select("appId", words.alias("tokens"))
    entries = F.transform("features", lambda f: F.concat_ws(":", f["bucket"], f["n"]))
    return hashing.features(docs, "appId", "tokens").select(
        "appId", "buckets", "tokens", F.array_join(entries, " ").alias("features")
    )


@register
def hashed_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens the hashed counts of each English document hold."""
    return hashed_features(spark, sf_dir).select("appId", "tokens")


def _model_terms(model: bayes.BayesModel) -> DataFrame:
    return model.term_probabilities().select(
        F.col("label").alias("segment"), "term", "n", F.round("log_prob", 4).alias("log_prob")
    )


@register
def nb_model_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_terms(segments.train(prepared(spark, sf_dir)))


@register
def nb_model_terms_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = segments.train(prepared(spark, sf_dir), smoothing=patterns.DEFAULT_SMOOTHING)
    return _model_terms(model)


@register
def nb_model_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class statistics of the fitted model, computed from its counts table."""
    model = segments.train(prepared(spark, sf_dir))
    is_term = F.col("term").isNotNull()
    per_class = model.counts.groupBy(F.col("label").alias("segment")).agg(
        F.sum(F.when(~is_term, F.col("n")).otherwise(0)).alias("docs"),
        F.sum(F.when(is_term, F.col("n")).otherwise(0)).alias("tokens"),
    )
    index = ranking.index_of(F.col("segment"), model.labels)
    prior = F.get(F.lit([model.prior(i) for i in range(len(model.classes))]), index)
    return per_class.select(
        "segment", index.alias("label_idx"), "docs", "tokens", F.round(prior, 6).alias("log_prior")
    )


def _trained(
    spark: SparkSession, sf_dir: str, only_english: bool = False
) -> tuple[bayes.BayesModel, DataFrame]:
    """The model of the English documents and all of them, cleaned once for both."""
    records = segments.preprocess_records(app_records(spark, sf_dir), only_english=only_english)
    return segments.train(records.where("english")), records


@register
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, records = _trained(spark, sf_dir)
    scored = segments.score_records(records, model, preprocessed=True)
    return segments.predict(scored, model).select("appId", "label_idx", "predictedLabel")


@register
def nb_raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, records = _trained(spark, sf_dir)
    scored = segments.score_records(records, model, preprocessed=True)
    return segments.raw_scores(scored, model).select(
        "appId", F.col("label").alias("segment"), F.round("score", 2).alias("score")
    )


def _hashed_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Class scores of all documents by the hashed model of the English ones, and its labels."""
    records = segments.preprocess_records(app_records(spark, sf_dir)).withColumn(
        "tokens", text.tokens(F.col("clean_description"))
    )
    model = hashing.fit(records.where("english").select("segment", "tokens"), "segment", "tokens")
    docs = records.select("appId", "tokens")
    return hashing.class_scores(docs, model, "appId", "tokens"), model.labels


@register
def hashed_nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, labels = _hashed_scores(spark, sf_dir)
    best = ranking.best_index(F.col("scores"))
    return scored.select(
        "appId", best.cast("double").alias("prediction"), ranking.label_at(best, labels).alias("predictedLabel")
    )


@register
def hashed_nb_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best labels of the hashed model."""
    scored, labels = _hashed_scores(spark, sf_dir)
    best = ranking.top_labels(F.col("scores"), labels, TOP_K)
    return scored.select("appId", F.array_join(best, " ").alias("topXPredictions"))


@register
def ovr_logreg_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest over 20 slots, fitted on the English documents and applied to them."""
    training = segments.prepare_training(
        app_records(spark, sf_dir), drop_stop_word_pieces=True
    ).select("appId", "segment", "clean_description")
    slotted = materialize(mllib.slots(training), "slots")
    model = onevsrest.fit(slotted, "segment", "slots")
    return onevsrest.predict(model, slotted, "slots").select("appId", "prediction", "predictedLabel")


# --- ranking, queries, evaluation --------------------------------------------------------


@register
def prepare_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("appId", "segment", "clean_description")


@register
def batch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, records = _trained(spark, sf_dir, only_english=True)
    return segments.batch_segments(records, model, preprocessed=True)


@register
def batch_segments_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of every comma-separated piece; the pieces of a document share its id."""
    model = segments.train(prepared(spark, sf_dir))
    pieces = app_records(spark, sf_dir).select(
        "appId", F.explode(text.comma_pieces(F.col("description"))).alias("description")
    )
    return segments.batch_segments(pieces, model)


@register
def batch_segments_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, records = _trained(spark, sf_dir, only_english=True)
    return segments.batch_segments(records, model, non_english="drop", preprocessed=True)


@register
def batch_segments_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and override both by detected language."""
    records = app_records(spark, sf_dir)
    profiles = langid.language_profiles(documents(spark, sf_dir), "text", "lang")
    keyed = records.select("appId", "description", *text.text_key(F.col("description")))
    detected = materialize(
        langid.detect_language(keyed, profiles, "appId", "description", carry=("_key_a", "_key_b")),
        "detected",
    )
    model = segments.train(segments.prepare_training(records, detected=detected))
    return segments.batch_segments(records, model, detected=detected)


@register
def top_k_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, records = _trained(spark, sf_dir)
    best = segments.top_segments(records, model, TOP_K, preprocessed=True)
    return best.select(
        "appId",
        "topXPredictions",
        writers.bracketed(F.col("appId"), F.col("topXPredictions")).alias("printed"),
    )


@register
def top_k_segments_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_segments(spark, sf_dir).select("appId", "topXPredictions").orderBy("appId")


@register
def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = app_records(spark, sf_dir).where(segments.is_english(F.col("description")))
    return segments.all_segments(english)


@register
def all_segments_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = app_records(spark, sf_dir).where(segments.is_english(F.col("description")))
    return segments.segments_text(english)


@register
def segment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_distribution(batch_segments(spark, sf_dir))


@register
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", evaluate.in_training_part(F.col("doc_id")).alias("in_training")
    )


def _labelled_predictions(records: DataFrame, model: bayes.BayesModel, preprocessed: bool = False) -> DataFrame:
    """``(appId, label, prediction)`` as label indexes."""
    label = ranking.index_of(F.col("segment"), model.labels)
    scored = segments.score_records(records.withColumn("label", label), model, carry=["label"], preprocessed=preprocessed)
    return segments.predict(scored, model).withColumnRenamed("label_idx", "prediction")


def _holdout_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = app_records(spark, sf_dir).where(segments.is_english(F.col("description")))
    in_training = evaluate.in_training_part(F.col("appId"))
    model = segments.train(segments.prepare_training(records.where(in_training)))
    return _labelled_predictions(records.where(~in_training), model)


def _training_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, records = _trained(spark, sf_dir, only_english=True)
    return _labelled_predictions(records.where("english"), model, preprocessed=True)


def _rounded(measured: DataFrame) -> DataFrame:
    return measured.select(*[F.round(name, 6).alias(name) for name in measured.columns])


@register
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_holdout_predictions(spark, sf_dir), "label", "prediction")


@register
def evaluate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the larger part of the English documents, measured on the rest."""
    return _rounded(evaluate.metrics(confusion_matrix(spark, sf_dir)))


@register
def evaluate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures as a report of four lines."""
    return evaluate.report(evaluate_metrics(spark, sf_dir))


@register
def evaluate_resubstitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured on the very documents the model was fitted on."""
    confused = evaluate.confusion(_training_predictions(spark, sf_dir), "label", "prediction")
    return _rounded(evaluate.metrics(confused))


@register
def describe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column summary of the scored training documents."""
    summary = evaluate.summarize(
        _training_predictions(spark, sf_dir), ["label", "prediction"], ["appId", "predictedLabel"]
    )
    return summary.select(
        "column_name",
        "count",
        F.round("mean", 6).alias("mean"),
        F.round("stddev", 6).alias("stddev"),
        "min",
        "max",
    )


# --- streams -----------------------------------------------------------------------------


@register
def sliding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sliding_report(table(spark, sf_dir, "events"), "ts", ["event_type"])


REPORTED = ["event_type", "user_id"]


@register
def sliding_report_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sliding_report_panes(table(spark, sf_dir, "events"), "ts", REPORTED)


@register
def sliding_report_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report from a stream of files; a closing event a day later lets the last windows end."""
    # A watermark takes a zoned timestamp.
    stamped = F.col("ts").cast("timestamp").alias("ts")
    events = table(spark, sf_dir, "events").select(stamped, *REPORTED)
    folder = new_path(spark, "closing-event")
    last = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in events.dtypes if name != "ts"]
    last.select("ts", *nothing).write.parquet(folder)
    stream = scoring.read_record_stream(
        spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema
    ).select(stamped, *REPORTED, F.lit(False).alias("closing"))
    closing = scoring.read_record_stream(spark, folder, events.schema).withColumn("closing", F.lit(True))
    path = new_path(spark, "report")
    streamed = report.sliding_report_panes(stream.unionByName(closing), "ts", [*REPORTED, "closing"], watermark="1 hour")
    report.write_report(streamed, path, new_path(spark, "report-checkpoint")).awaitTermination()
    found = spark.read.schema(streamed.schema).parquet(path).where(F.col("attribute") != "closing")
    zoneless = [F.col(name).cast("timestamp_ntz").alias(name) for name in ("window_start", "window_end")]
    return found.select(*zoneless, "attribute", "value", "n")


@register
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents classified as a stream of files, until all are read."""
    model = segments.train(prepared(spark, sf_dir))
    stream = scoring.read_record_stream(
        spark, f"{sf_dir}/documents*.parquet", documents(spark, sf_dir).schema
    )
    records = stream.select(
        F.col("doc_id").cast("string").alias("appId"), F.col("text").alias("description")
    )
    path = new_path(spark, "stream-out")
    query = scoring.score_stream(
        records,
        lambda batch: segments.batch_segments(batch, model),
        path,
        new_path(spark, "stream-checkpoint"),
    )
    query.awaitTermination()
    return spark.read.parquet(path).select("appId", "predictedLabelFinal")

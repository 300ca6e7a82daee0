"""SQL counterparts of the registered queries, for an independent check in DuckDB.

Written from the meaning of each operator, not from its DataFrame code: the cleaning chain is
the step-by-step form, the classifier joins terms and classes outright.
"""

from __future__ import annotations

from tagloom.functions.stopwords import ENGLISH

TOP_K = 3

STOP_LIST = ", ".join("'" + word.replace("'", "''") + "'" for word in ENGLISH)

# Fixed values. The six patterns in cleaning order (the doubled boundary written once).
STEPS = (
    ("urls", r"(https?\://)\S+"),
    ("punctuation", r"[^a-zA-Z0-9]"),
    ("digits", r"\b\d+\b"),
    ("small_words", r"\b[a-zA-Z0-9]{1,2}\b"),
    (
        "alphanumerics",
        r"(\b[0-9]+[a-zA-Z]+\b)|(\b[a-zA-Z]+[0-9]+\b)|(\b[a-zA-Z]+[0-9]+[a-zA-Z]+\b)",
    ),
    ("white_space", r"\s+"),
)

LEMMA_STEPS = (
    (r"\b([a-z0-9]{2,})ies\b", r"\1y"),
    (r"\b([a-z0-9]*(?:[b-df-hj-np-tv-z]at|iz|[aeiouy][a-z0-9]*(?:bl|[cuv])))(?:ing|ed)\b", r"\1e"),
    (
        r"\b([a-z0-9]*[aeiouy])(?:(b)b|(d)d|(g)g|(m)m|(n)n|(p)p|(r)r|(t)t)(?:ing|ed)\b",
        r"\1\2\3\4\5\6\7\8\9",
    ),
    (
        r"\b(?:([a-z0-9]*[aeiouy][a-z0-9]+)(?:ing|ed)"
        r"|([a-z0-9]*(?:ss|x|ch|sh|zz))es"
        r"|([a-z0-9]{2,}[a-hj-rtv-z0-9])s)\b",
        r"\1\2\3",
    ),
)


def _chain(column: str, last: str = "white_space") -> str:
    sql = f"lower({column})"
    for name, pattern in STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', ' ', 'g')"
        if name == last:
            break
    return sql


def _kept(sql: str) -> str:
    return (
        f"array_to_string(list_filter(string_split({sql}, ' '), "
        f"lambda w: w <> '' AND w NOT IN ({STOP_LIST})), ' ')"
    )


def _clean(column: str) -> str:
    return _kept(_chain(column))


def _lemma(sql: str) -> str:
    for pattern, replacement in LEMMA_STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'g')"
    return sql


def _preprocess(column: str) -> str:
    return _lemma(_clean(column))


ASCII = "NOT regexp_matches(text, '[^\\x00-\\x7F]')"
TRAINING_PART = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 2) < 'cc'"
PIECES = (
    "CASE WHEN regexp_full_match(text, ',+') THEN [] "
    "ELSE string_split(regexp_replace(text, ',+$', ''), ',') END"
)


def _documents(expression: str, out: str) -> str:
    return f"SELECT doc_id, {expression} AS {out} FROM documents"


# Every document with its class and its tokens; one empty token for an empty text.
RECORDS = f"""
records AS MATERIALIZED (
  SELECT doc_id, source AS class, {ASCII} AS english,
         string_split({_preprocess("text")}, ' ') AS words
  FROM documents)"""


# The documents to learn from and their comma pieces to score, numbered within the document.
PIECE_RECORDS = f"""
pieces AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, text, true AS whole FROM documents
  UNION ALL
  SELECT doc_id || '#' || generate_subscripts(pieces, 1), source, unnest(pieces), false
  FROM (SELECT doc_id, source, {PIECES} AS pieces FROM documents)),
records AS MATERIALIZED (
  SELECT doc_id, source AS class, {ASCII} AS english, whole,
         string_split({_preprocess("text")}, ' ') AS words
  FROM pieces)"""


def _bayes(
    records: str,
    train: str,
    score: str,
    smoothing: str = "0.001e0",
    features: int = 10_000,
    uniform: bool = False,
) -> str:
    """CTEs up to ``scores(doc_id, class, idx, score)``; ``records(doc_id, class, words, ...)``."""
    prior = (
        "-ln(k)" if uniform else f"ln((docs + {smoothing}) / (all_docs + k * {smoothing}))"
    )
    return f"""
WITH {records},
term_n AS MATERIALIZED (
  SELECT class, w, count(*) AS n
  FROM (SELECT class, unnest(words) AS w FROM records WHERE {train}) GROUP BY class, w),
totals AS (SELECT class, CAST(sum(n) AS BIGINT) AS tokens FROM term_n GROUP BY class),
class_docs AS (SELECT class, count(*) AS docs FROM records WHERE {train} GROUP BY class),
sized AS (
  SELECT class, docs, coalesce(tokens, 0) AS tokens,
         row_number() OVER (ORDER BY docs DESC, class) - 1 AS idx,
         sum(docs) OVER () AS all_docs, count(*) OVER () AS k
  FROM class_docs LEFT JOIN totals USING (class)),
classes AS MATERIALIZED (
  SELECT class, idx, docs, tokens, {prior} AS prior,
         ln({smoothing} / (tokens + {smoothing} * {features})) AS base
  FROM sized),
token_n AS (
  SELECT doc_id, w, count(*) AS tf
  FROM (SELECT doc_id, unnest(words) AS w FROM records WHERE {score}) GROUP BY doc_id, w),
hits AS (
  SELECT doc_id, class, sum(tf * ln((n + {smoothing}) / {smoothing})) AS s
  FROM token_n JOIN term_n USING (w) GROUP BY doc_id, class),
scores AS MATERIALIZED (
  SELECT r.doc_id, r.class AS own, r.english, c.class, c.idx,
         c.prior + greatest(len(r.words), 1) * c.base + coalesce(h.s, 0) AS score
  FROM (SELECT * FROM records WHERE {score}) r CROSS JOIN classes c
  LEFT JOIN hits h ON h.doc_id = r.doc_id AND h.class = c.class),
best AS (
  SELECT doc_id, own, english, class, idx FROM scores
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, idx) = 1)
"""


ALL = _bayes(RECORDS, "english", "true")
FINAL = "CASE WHEN english THEN class ELSE 'Not supported language' END"
BATCH = f"{ALL} SELECT CAST(doc_id AS VARCHAR) AS appId, {FINAL} AS predictedLabelFinal FROM best"

HOLDOUT = _bayes(RECORDS, f"english AND {TRAINING_PART}", f"english AND NOT {TRAINING_PART}")
RESUBSTITUTION = _bayes(RECORDS, "english", "english")

_LETTERS = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' '"
GRAMS = f"""
records AS MATERIALIZED (
  SELECT doc_id, lang AS class, true AS english,
         list_filter(
           list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)),
           lambda g: substr(g, 2, 1) <> ' ') AS words
  FROM (SELECT doc_id, lang, {_LETTERS} AS t FROM documents))"""
LANGUAGES = _bayes(GRAMS, "true", "true", "1e0", 65_536, uniform=True)
DETECTED = f"""{LANGUAGES},
ordered AS (
  SELECT doc_id, class, idx, round(score, 6) AS score,
         lead(round(score, 6)) OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, idx) AS second,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, idx) AS rank
  FROM scores),
detected AS (
  SELECT doc_id, CASE WHEN score - second >= 9.21e0 THEN class END AS lang_pred
  FROM ordered WHERE rank = 1)
"""


def _model_terms(smoothing: str) -> str:
    return f"""{_bayes(RECORDS, "english", "false", smoothing)}
SELECT class AS segment, w AS term, n,
       round(ln((n + {smoothing}) / (tokens + {smoothing} * 10000)), 4) AS log_prob
FROM term_n JOIN classes USING (class)"""


def _confused(base: str) -> str:
    return f"""{base},
confused AS (
  SELECT l.idx AS label, b.idx AS prediction, count(*) AS n
  FROM best b LEFT JOIN classes l ON l.class = b.own GROUP BY l.idx, b.idx)"""


def _metrics(base: str) -> str:
    return f"""{_confused(base)},
rows_of AS (SELECT label AS class, sum(n) AS actual FROM confused GROUP BY label),
columns_of AS (SELECT prediction AS class, sum(n) AS predicted FROM confused GROUP BY prediction),
hits_of AS (SELECT label AS class, sum(n) AS hits FROM confused WHERE label = prediction GROUP BY label),
per_class AS (
  SELECT actual, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
  FROM rows_of LEFT JOIN columns_of USING (class) LEFT JOIN hits_of USING (class)),
rates AS (
  SELECT actual, hits, CASE WHEN predicted = 0 THEN 0e0 ELSE hits / CAST(predicted AS DOUBLE) END AS p,
         hits / CAST(actual AS DOUBLE) AS r FROM per_class)
SELECT round(CAST(sum(hits) AS DOUBLE) / CAST(sum(actual) AS DOUBLE), 6) AS accuracy,
       round(sum(actual * p) / CAST(sum(actual) AS DOUBLE), 6) AS weighted_precision,
       round(sum(actual * r) / CAST(sum(actual) AS DOUBLE), 6) AS weighted_recall,
       round(sum(actual * CASE WHEN p + r = 0 THEN 0e0 ELSE 2 * p * r / (p + r) END)
             / CAST(sum(actual) AS DOUBLE), 6) AS f1
FROM rates"""


def _describe(name: str, value: str, numeric: bool) -> str:
    mean = f"round(avg({value}), 6)" if numeric else "CAST(NULL AS DOUBLE)"
    deviation = f"round(stddev_samp({value}), 6)" if numeric else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS column_name, count({value}) AS count, {mean} AS mean,
  {deviation} AS stddev, CAST(min({value}) AS VARCHAR) AS min, CAST(max({value}) AS VARCHAR) AS max
FROM described"""


TOP = f"""{ALL},
ranked AS (
  SELECT doc_id, class, row_number() OVER (
    PARTITION BY doc_id ORDER BY round(score, 6) DESC, idx DESC) AS rank FROM scores),
tops AS (
  SELECT CAST(doc_id AS VARCHAR) AS appId, string_agg(class, ' ' ORDER BY rank) AS topXPredictions
  FROM ranked WHERE rank <= {TOP_K} GROUP BY doc_id)
"""

CLEANED = f"""
cleaned AS MATERIALIZED (SELECT doc_id, lang, source, {_clean("text")} AS cleaned FROM documents),
words AS MATERIALIZED (
  SELECT doc_id, lang, source, unnest(string_split(cleaned, ' ')) AS word,
         generate_subscripts(string_split(cleaned, ' '), 1) AS position FROM cleaned)"""

_PLAIN_RECORD = "CAST(NULL AS VARCHAR) AS package, CAST(NULL AS VARCHAR) AS appName"
_NO_CONTROL = "regexp_replace(text, '[\\x00-\\x1F]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    # sources and sinks
    "ingest_delimited": f"""SELECT CAST(doc_id AS VARCHAR) AS appId, lang AS package,
  source AS appName, {_NO_CONTROL} AS description, source AS segment FROM documents""",
    "ingest_json_batch": f"""SELECT CAST(doc_id AS VARCHAR) AS appId, {_PLAIN_RECORD},
  text AS description, source AS segment FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR) || '-bare', NULL, NULL, NULL, NULL FROM documents""",
    "ingest_json_broken": """SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS appId,
  CASE WHEN doc_id % 2 = 0 THEN source END AS segment,
  CASE WHEN doc_id % 2 <> 0 THEN '[{"appId":"' || doc_id || '","segment":"' || source
    || '"},{"appId":"x"' END AS corrupt FROM documents""",
    "ingest_json_file": """SELECT CAST(doc_id AS VARCHAR) AS appId, CAST(NULL AS VARCHAR) AS package,
  source AS appName, text AS description FROM documents""",
    "clean_documents": f"SELECT page_id, {_clean('html')} AS cleaned FROM pages",
    "batch_segments_json": f"""{ALL} SELECT '{{"appId":"' || doc_id || '","predictedLabelFinal":"'
  || {FINAL} || '"}}' AS json FROM best""",
    "nb_model_roundtrip": BATCH,
    # predicates and overrides
    "filter_ascii_english": f"SELECT doc_id, lang, n_chars FROM documents WHERE {ASCII}",
    "filter_detected_english": f"{DETECTED} SELECT * FROM detected WHERE lang_pred = 'en'",
    "filter_allowed_chars": f"""SELECT * FROM (
  SELECT doc_id, CAST(unnest(range(len(pieces))) AS INTEGER) AS position, unnest(pieces) AS piece
  FROM (SELECT doc_id, {PIECES} AS pieces FROM documents))
WHERE regexp_matches(piece, '^[a-zA-Z0-9$@$!%*?&#^-_. +]+$')""",
    "override_non_english": _documents(
        f"CASE WHEN {ASCII} THEN source ELSE 'Not supported language' END", "final_label"
    ),
    # text
    "text_lower": _documents("lower(text)", "lowered"),
    "strip_urls": _documents(_chain("text", "urls"), "stripped"),
    "strip_punctuation": _documents(_chain("text", "punctuation"), "stripped"),
    "strip_digits": _documents(_chain("text", "digits"), "stripped"),
    "strip_small_words": _documents(_chain("text", "small_words"), "stripped"),
    "strip_alphanumerics": _documents(_chain("text", "alphanumerics"), "stripped"),
    "collapse_whitespace": _documents(_chain("text"), "stripped"),
    "clean_text": _documents(_clean("text"), "cleaned"),
    "preprocess_text": _documents(_preprocess("text"), "preprocessed"),
    "strip_non_ascii": _documents("regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')", "stripped"),
    "strip_control_chars": _documents(_NO_CONTROL, "stripped"),
    "remove_pattern": """SELECT doc_id,
  regexp_replace(text, '(https?\\://)\\S+', ' ', 'g') AS without_urls,
  regexp_replace(text, '[^a-zA-Z0-9]', ' ', 'g') AS without_punctuation,
  regexp_replace(text, '\\s+', ' ', 'g') AS without_white_space FROM documents""",
    "remove_stopwords": _documents(_kept("lower(text)"), "kept"),
    "split_segments": f"""SELECT doc_id, CAST(unnest(range(len(pieces))) AS INTEGER) AS position,
  unnest(pieces) AS piece FROM (SELECT doc_id, {PIECES} AS pieces FROM documents)""",
    "stopword_segments": _documents(
        f"array_to_string(list_filter({PIECES}, lambda p: lower(p) NOT IN ({STOP_LIST})), ',')",
        "joined",
    ),
    "tokenize": f"""SELECT doc_id, CAST(len(words) AS INTEGER) AS n_tokens,
  array_to_string(words, '|') AS tokens
FROM (SELECT doc_id, string_split({_clean("text")}, ' ') AS words FROM documents)""",
    # words against tables
    "lemmatize_vocab": f"""WITH {CLEANED}
SELECT word, {_lemma("word")} AS lemma FROM (SELECT DISTINCT word FROM words)""",
    "lookup_replace": f"""WITH {CLEANED},
entries AS (
  SELECT word, source AS value FROM words WHERE length(word) >= 6 GROUP BY word, source
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, source) = 1)
SELECT doc_id, string_agg(coalesce(value, word), ' ' ORDER BY position) AS replaced
FROM words LEFT JOIN entries USING (word) GROUP BY doc_id""",
    "lemmatize_lexicon": f"""WITH {CLEANED},
entries AS (
  SELECT word, source AS value FROM words WHERE length(word) >= 6 GROUP BY word, source
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, source) = 1)
SELECT doc_id, string_agg(coalesce(value, {_lemma("word")}), ' ' ORDER BY position) AS lemmas
FROM words LEFT JOIN entries USING (word) GROUP BY doc_id""",
    "drop_listed_words": f"""WITH {CLEANED},
listed AS (
  SELECT word FROM words GROUP BY word
  HAVING count(DISTINCT doc_id) >= (SELECT count(*) FROM documents) / 10e0),
others AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY position) AS others
  FROM words ANTI JOIN listed USING (word) WHERE word <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN cleaned IS NOT NULL THEN coalesce(others, '') END AS kept
FROM cleaned LEFT JOIN others USING (doc_id)""",
    "annotate_tokens": f"""WITH {CLEANED},
tags AS (
  SELECT word, upper(lang) AS tag FROM words WHERE length(word) >= 5 GROUP BY word, lang
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, upper(lang)) = 1)
SELECT doc_id, string_agg(word || '|' || coalesce(tag, 'XX'), ',' ORDER BY position) AS annotated
FROM words LEFT JOIN tags USING (word) GROUP BY doc_id""",
    "language_profiles": f"{LANGUAGES} SELECT class AS lang, w AS ngram, n FROM term_n",
    "detect_language": f"{DETECTED} SELECT * FROM detected",
    # features and models
    "label_index": f"""SELECT source AS label, count(*) AS docs,
  CAST(row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS INTEGER) AS label_idx
FROM documents WHERE {ASCII} GROUP BY source""",
    "term_counts": f"""WITH {RECORDS}
SELECT CAST(doc_id AS VARCHAR) AS appId, term, count(*) AS tf
FROM (SELECT doc_id, unnest(words) AS term FROM records WHERE english) GROUP BY doc_id, term""",
    "hashed_token_totals": f"""WITH {RECORDS}
SELECT CAST(doc_id AS VARCHAR) AS appId, CAST(len(words) AS BIGINT) AS tokens
FROM records WHERE english""",
    "nb_model_terms": _model_terms("0.001e0"),
    "nb_model_terms_s1": _model_terms("1e0"),
    "nb_model_priors": f"""{_bayes(RECORDS, "english", "false")}
SELECT class AS segment, CAST(idx AS INTEGER) AS label_idx, docs, tokens,
  round(prior, 6) AS log_prior FROM classes""",
    "nb_predict": f"""{ALL} SELECT CAST(doc_id AS VARCHAR) AS appId,
  CAST(idx AS INTEGER) AS label_idx, class AS predictedLabel FROM best""",
    "nb_raw_scores": f"""{ALL} SELECT CAST(doc_id AS VARCHAR) AS appId, class AS segment,
  round(score, 2) AS score FROM scores""",
    # ranking, queries, evaluation
    "prepare_training": f"""SELECT CAST(doc_id AS VARCHAR) AS appId, source AS segment,
  {_preprocess("text")} AS clean_description FROM documents WHERE {ASCII}""",
    "batch_segments": BATCH,
    "batch_segments_pieces": f"""{_bayes(PIECE_RECORDS, "whole AND english", "NOT whole")}
SELECT split_part(doc_id, '#', 1) AS appId, {FINAL} AS predictedLabelFinal FROM best""",
    "batch_segments_drop": f"{BATCH} WHERE english",
    "batch_segments_detected": f"""
WITH detected AS MATERIALIZED ({DETECTED} SELECT * FROM detected),
{_bayes(RECORDS.replace("FROM documents", "FROM documents JOIN detected USING (doc_id)")
        .replace(ASCII, "coalesce(lang_pred = 'en', false)"), "english", "true").lstrip()[len("WITH "):]}
SELECT CAST(doc_id AS VARCHAR) AS appId, {FINAL} AS predictedLabelFinal FROM best""",
    "top_k_segments": f"""{TOP} SELECT appId, topXPredictions,
  '[' || appId || ',' || topXPredictions || ']' AS printed FROM tops""",
    "top_k_segments_sorted": f"{TOP} SELECT appId, topXPredictions FROM tops ORDER BY appId",
    "all_segments": f"SELECT DISTINCT source AS segment FROM documents WHERE {ASCII}",
    "all_segments_text": f"""SELECT '[' || string_agg(source, ',' ORDER BY source) || ']' AS segments
FROM (SELECT DISTINCT source FROM documents WHERE {ASCII})""",
    "segment_distribution": f"""{ALL} SELECT {FINAL} AS predictedLabelFinal, count(*) AS n
FROM best GROUP BY 1""",
    "holdout_split": _documents(TRAINING_PART, "in_training"),
    "confusion_matrix": f"""{_confused(HOLDOUT)}
SELECT CAST(label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction, n FROM confused""",
    "evaluate_metrics": _metrics(HOLDOUT),
    "evaluate_report": f"""SELECT concat_ws(chr(10), 'Accuracy: ' || accuracy,
  'Precision: ' || weighted_precision, 'Recall: ' || weighted_recall, 'F1: ' || f1) AS report
FROM ({_metrics(HOLDOUT)})""",
    "evaluate_resubstitution": _metrics(RESUBSTITUTION),
    "describe_summary": f"""{RESUBSTITUTION},
described AS (
  SELECT CAST(b.doc_id AS VARCHAR) AS appId, l.idx AS label, b.idx AS prediction,
         b.class AS predictedLabel
  FROM best b LEFT JOIN classes l ON l.class = b.own)
{_describe("label", "label", True)}
UNION ALL {_describe("prediction", "prediction", True)}
UNION ALL {_describe("appId", "appId", False)}
UNION ALL {_describe("predictedLabel", "predictedLabel", False)}""",
    # streams
    "sliding_report": """WITH steps AS (
  SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS window_start
  FROM events CROSS JOIN range(6) AS r(i))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM steps GROUP BY window_start, event_type""",
    "stream_score": BATCH,
}

# --- taggers and base forms by tag -----------------------------------------------------------

TAGS = """
training AS MATERIALIZED (
  SELECT doc_id, position, word, upper(lang) AS tag FROM words WHERE {part} AND lang IS NOT NULL),
tags AS (SELECT tag, row_number() OVER (ORDER BY tag) AS i, n FROM (
  SELECT tag, count(*) AS n FROM training GROUP BY tag)),
moved AS (
  SELECT tag AS a, lead(tag) OVER (PARTITION BY doc_id ORDER BY position) AS b FROM training),
moves AS MATERIALIZED (
  SELECT a.i AS a, b.i AS b, floor(ln((count(m.a) + 0.1e0)
    / (sum(count(m.a)) OVER (PARTITION BY a.i) + 0.1e0 * (SELECT count(*) FROM tags))) * 1e6 + 0.5e0)::BIGINT AS v
  FROM tags a CROSS JOIN tags b LEFT JOIN moved m ON m.a = a.tag AND m.b = b.tag GROUP BY a.i, b.i),
start AS (
  SELECT b.i, floor(ln((count(t.tag) + 0.1e0)
    / (sum(count(t.tag)) OVER () + 0.1e0 * (SELECT count(*) FROM tags))) * 1e6 + 0.5e0)::BIGINT AS v
  FROM tags b LEFT JOIN training t ON t.tag = b.tag AND t.position = 1 GROUP BY b.i),
counts AS MATERIALIZED (SELECT word, tag, count(*) AS n FROM training GROUP BY ALL),
emissions AS MATERIALIZED (
  SELECT word, list(v ORDER BY i) AS v FROM (
    SELECT w.word, t.i, round(ln((coalesce(c.n, 0) + 0.1e0) / (t.n + 0.1e0 * (
      (SELECT count(DISTINCT word) FROM counts) + 1))) * 1e6)::BIGINT AS v
    FROM (SELECT DISTINCT word FROM counts) w CROSS JOIN tags t
    LEFT JOIN counts c ON c.word = w.word AND c.tag = t.tag) GROUP BY word),
rare AS MATERIALIZED (
  SELECT * FROM counts WHERE word IN (SELECT word FROM counts GROUP BY word HAVING sum(n) <= 10)),
rare_tags AS (SELECT t.tag, t.i, coalesce(sum(r.n), 0) AS n FROM tags t LEFT JOIN rare r ON r.tag = t.tag GROUP BY ALL),
ended AS MATERIALIZED (
  SELECT l, right(word, l) AS ending, tag, sum(n) AS n
  FROM rare CROSS JOIN (VALUES (1), (2), (3)) AS lengths(l) WHERE length(word) >= l GROUP BY ALL),
endings AS MATERIALIZED (
  SELECT l, ending, list(v ORDER BY i) AS v FROM (
    SELECT e.l, e.ending, t.i, round(ln((coalesce(c.n, 0) + 0.1e0) / (t.n + 0.1e0 * (e.kinds + 1))) * 1e6)::BIGINT AS v
    FROM (SELECT DISTINCT l, ending, k.kinds FROM ended JOIN (
            SELECT l, count(DISTINCT ending) AS kinds FROM ended GROUP BY l) k USING (l)) e
    CROSS JOIN rare_tags t
    LEFT JOIN ended c ON c.l = e.l AND c.ending = e.ending AND c.tag = t.tag) GROUP BY l, ending),
judged AS MATERIALIZED (
  SELECT w.word, coalesce(m.v, e3.v, e2.v, e1.v, (SELECT list(0::BIGINT) FROM tags)) AS v
  FROM (SELECT DISTINCT word FROM words) w
  LEFT JOIN emissions m ON m.word = w.word
  LEFT JOIN endings e3 ON e3.l = 3 AND length(w.word) >= 3 AND e3.ending = right(w.word, 3)
  LEFT JOIN endings e2 ON e2.l = 2 AND length(w.word) >= 2 AND e2.ending = right(w.word, 2)
  LEFT JOIN endings e1 ON e1.l = 1 AND length(w.word) >= 1 AND e1.ending = right(w.word, 1)),
chains AS (
  SELECT doc_id, list(v ORDER BY position) AS e FROM words JOIN judged USING (word) GROUP BY doc_id),
model AS MATERIALIZED (
  SELECT (SELECT list(v ORDER BY i) FROM start) AS s, (SELECT list(tag ORDER BY i) FROM tags) AS names,
         (SELECT list(v ORDER BY b) FROM (SELECT b, list(v ORDER BY a) AS v FROM moves GROUP BY b)) AS inward),
walked AS (
  SELECT doc_id, names, list_reduce(e[2:], lambda acc, x: {{
      'f': list_transform(inward, lambda m, b: list_max(list_transform(m, lambda v, a: v + acc.f[a])) + x[b]),
      'k': list_append(acc.k, list_transform(inward, lambda m: list_position(
        list_transform(m, lambda v, a: v + acc.f[a]), list_max(list_transform(m, lambda v, a: v + acc.f[a]))))::INT[])}},
    {{'f': list_transform(s, lambda v, b: v + e[1][b]), 'k': []::INT[][]}}) AS r
  FROM chains CROSS JOIN model),
traced AS (
  SELECT doc_id, names, list_reduce(list_reverse(r.k), lambda acc, k: list_append(acc, k[acc[-1]]),
    [list_position(r.f, list_max(r.f))]::INT[]) AS path FROM walked)"""

ORACLE_SQL["tag_sequence"] = f"""WITH {CLEANED}, {TAGS.format(part=TRAINING_PART)}
SELECT c.doc_id, array_to_string(list_transform(list_reverse(path), lambda i: names[i]), ' ') AS tags
FROM cleaned c LEFT JOIN traced t ON t.doc_id = c.doc_id"""

_WORD_PART = "substr(md5(word), 1, 2) < 'cc'"
ORACLE_SQL["lemmatize_tagged"] = f"""WITH {CLEANED},
pairs AS MATERIALIZED (SELECT DISTINCT word, upper(lang) AS tag FROM words WHERE word <> ''),
listed AS (
  SELECT word, tag, CASE WHEN tag = 'EN' THEN {_lemma("word")} ELSE word END AS lemma
  FROM pairs WHERE {_WORD_PART} AND tag IS NOT NULL),
scripts AS (
  SELECT word, tag, length(word) - same AS cut, substr(lemma, same + 1) AS add
  FROM (SELECT *, len(list_filter(range(1, least(length(word), length(lemma)) + 1),
                  lambda i: left(word, i) = left(lemma, i))) AS same FROM listed)),
votes AS (
  SELECT tag, d AS depth, CASE WHEN d = 7 THEN '^' || word ELSE right(word, d) END AS ending, cut, add, count(*) AS n
  FROM scripts CROSS JOIN range(8) AS depths(d) WHERE d = 7 OR d <= length(word) GROUP BY ALL),
trie AS MATERIALIZED (
  SELECT tag, ending, depth, cut, add FROM votes
  QUALIFY row_number() OVER (PARTITION BY tag, ending, depth ORDER BY n DESC, cut, add) = 1
    AND (depth IN (0, 7) OR sum(n) OVER (PARTITION BY tag, ending, depth) >= 2)),
found AS (
  SELECT p.word, p.tag, t.cut, t.add FROM pairs p
  JOIN (SELECT unnest(range(8)) AS d) depths ON d = 7 OR d <= length(p.word)
  JOIN trie t ON t.tag = p.tag AND t.depth = d
    AND t.ending = CASE WHEN d = 7 THEN '^' || p.word ELSE right(p.word, d) END
  QUALIFY row_number() OVER (PARTITION BY p.word, p.tag ORDER BY d DESC) = 1)
SELECT word, tag, CASE WHEN cut <= length(word) THEN left(word, length(word) - cut) || add ELSE word END AS lemma
FROM pairs LEFT JOIN found USING (word, tag)"""

# --- hashed terms ------------------------------------------------------------------------------

_BUCKET = "(('0x' || substr(md5(w), 1, 8))::BIGINT % 10000)"
HASHED_RECORDS = f"""
plain AS MATERIALIZED (
  SELECT doc_id, source AS class, {ASCII} AS english, string_split({_preprocess("text")}, ' ') AS words
  FROM documents),
records AS MATERIALIZED (
  SELECT doc_id, class, english, list_transform(words, lambda w: {_BUCKET}::VARCHAR) AS words FROM plain)"""
_HASHED = _bayes(HASHED_RECORDS, "english", "true")

ORACLE_SQL["hashed_features"] = f"""WITH {HASHED_RECORDS},
counted AS (
  SELECT doc_id, w::INT AS bucket, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS w FROM records WHERE english) GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS appId, CAST(count(*) AS INTEGER) AS buckets, CAST(sum(n) AS BIGINT) AS tokens,
  string_agg(bucket || ':' || n, ' ' ORDER BY bucket) AS features FROM counted GROUP BY doc_id"""
ORACLE_SQL["hashed_nb_predict"] = f"""{_HASHED} SELECT CAST(doc_id AS VARCHAR) AS appId,
  CAST(idx AS DOUBLE) AS prediction, class AS predictedLabel FROM best"""
ORACLE_SQL["hashed_nb_top_k"] = f"""{_HASHED}
SELECT CAST(doc_id AS VARCHAR) AS appId, string_agg(class, ' ' ORDER BY rank) AS topXPredictions FROM (
  SELECT doc_id, class, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, idx DESC) AS rank
  FROM scores) WHERE rank <= {TOP_K} GROUP BY doc_id"""

# --- languages of short texts --------------------------------------------------------------------

_SHORT = f"""list_concat(
  list_filter(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), lambda g: g <> ' '),
  list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda g: g <> '  '),
  list_filter(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), lambda g: substr(g, 2, 1) <> ' '))"""
# Grams lie within a word and the blanks around it: distinct words are cut up once.
_WORDS = "unnest(string_split(trim(t), ' ')) AS w"
ORACLE_SQL["detect_language_short"] = f"""WITH word_n AS (
  SELECT lang, ' ' || w || ' ' AS t, count(*) AS n FROM (
    SELECT lang, {_WORDS} FROM (SELECT lang, {_LETTERS} AS t FROM documents WHERE lang IS NOT NULL))
  WHERE w <> '' GROUP BY ALL),
gram_n AS MATERIALIZED (
  SELECT lang, g, sum(n) AS n FROM (SELECT lang, n, unnest({_SHORT}) AS g FROM word_n) GROUP BY lang, g),
totals AS (SELECT lang, length(g) AS k, sum(n) AS n FROM gram_n GROUP BY ALL),
langs AS (SELECT DISTINCT lang FROM gram_n),
factors AS MATERIALIZED (
  SELECT g.g, l.lang, round(ln(coalesce(n.n, 0) / coalesce(t.n, 1)::DOUBLE + 0.5e0 / 10000) * 1e6) AS f
  FROM (SELECT DISTINCT g FROM gram_n) g CROSS JOIN langs l
  LEFT JOIN gram_n n ON n.g = g.g AND n.lang = l.lang
  LEFT JOIN totals t ON t.lang = l.lang AND t.k = length(g.g)),
turns AS MATERIALIZED (SELECT row_number() OVER () AS row, conv_id, turn, {_LETTERS} AS t FROM conversations),
turn_words AS (
  SELECT row, ' ' || w || ' ' AS t FROM (SELECT row, {_WORDS} FROM turns) WHERE w <> ''),
sums AS (
  SELECT row, lang, sum(f) AS s
  FROM (SELECT row, unnest({_SHORT}) AS g FROM turn_words) JOIN factors USING (g) GROUP BY row, lang),
best AS (
  SELECT row, lang, 1 / sum(exp((s - top) / 1e6)) OVER (PARTITION BY row) AS p, s = top AS is_top
  FROM (SELECT *, max(s) OVER (PARTITION BY row) AS top FROM sums))
SELECT conv_id, turn, min(CASE WHEN p >= 0.9999e0 AND is_top THEN lang END) AS lang_pred
FROM turns LEFT JOIN best USING (row) GROUP BY row, conv_id, turn"""

# --- reports by listed attributes, word-list files -------------------------------------------------

ORACLE_SQL["sliding_report_panes"] = """WITH each AS (
  SELECT ts, 'event_type' AS attribute, event_type AS value FROM events
  UNION ALL SELECT ts, 'user_id', CAST(user_id AS VARCHAR) FROM events),
steps AS (
  SELECT attribute, value, time_bucket(INTERVAL 10 MINUTE, ts) - i * INTERVAL 10 MINUTE AS window_start
  FROM each CROSS JOIN range(6) AS r(i) WHERE ts IS NOT NULL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, attribute, value, count(*) AS n
FROM steps GROUP BY ALL"""
ORACLE_SQL["sliding_report_stream"] = ORACLE_SQL["sliding_report_panes"]
ORACLE_SQL["drop_words_from_file"] = f"""WITH {CLEANED},
listed AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark),
others AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY position) AS others
  FROM words ANTI JOIN listed USING (word) WHERE word <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN cleaned IS NOT NULL THEN coalesce(others, '') END AS kept
FROM cleaned LEFT JOIN others USING (doc_id)"""

ORACLE_SQL["ingest_json_array"] = """SELECT CAST(doc_id AS VARCHAR) AS appId, CAST(NULL AS VARCHAR) AS package,
  source AS appName, text AS description FROM documents"""
ORACLE_SQL["clean_folder_roundtrip"] = f"SELECT page_id, {_clean('html')} AS cleaned FROM pages WHERE html IS NOT NULL"

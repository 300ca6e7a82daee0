import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.functions.lemma import lemma

STOP = ["now", "the", "and", "of"]

CLEANING = [
    ("Play FREE Chess! Visit https://x.co/a?b=1 now.", "play free chess visit now ", "play free chess visit"),
    ("Don't stop 4ever h2o b2b4c v10 3 abc123def 12abc34", " don stop b2b4c 12abc34", "don stop b2b4c 12abc34"),
    ("café naïve", "caf ", "caf"),
    ("", "", ""),
    ("the and of", "the and ", ""),
    (None, None, None),
    ("  Fast\tcar\n racing,,", " fast car racing ", "fast car racing"),
    ("UPPER Lower 2024 2go go", "upper lower ", "upper lower"),
    ("1 2 3", " ", ""),
    ("12 foo", " foo", "foo"),
    ("abhttps://x y", " ", ""),
    ("xyzhttp://x.y abc", "xyz abc", "xyz abc"),
]


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(expression(F.col("text")).alias("out")).first().out


@pytest.mark.parametrize("raw,regex,cleaned", CLEANING)
def test_cleaning(spark, raw, regex, cleaned):
    assert one(spark, raw, lambda c: text.clean_text(c, STOP)) == cleaned
    # A leading blank is the only freedom the step form leaves.
    stepped = one(spark, raw, lambda c: text.clean_up_to(c, "white_space"))
    assert (stepped or "").strip() == (regex or "").strip()


def same_both_ways(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "text string")
    words = text.default_stop_words()
    steps = text.drop_words(text.clean_up_to(F.col("text"), "white_space"), words)
    rows = df.select("text", text.clean_text(F.col("text"), words).alias("a"), steps.alias("b")).collect()
    for row in rows:
        assert row.a == row.b, row.text


PIECE = st.sampled_from(
    ["a", "ab", "abc", "1", "12", "a1", "a1b", "1a", "1a2", "ab12cd3", "http://", "https://x.y/z",
     " ", "  ", "\n", "\t", ",", "!", "é", "ß", "İ", "日本", "the", "don't", " ", "_", "😀", "ABC"]
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECE, max_size=25).map("".join), min_size=200, max_size=200))
def test_one_pass_equals_the_steps(spark, values):
    same_both_ways(spark, values)


def test_one_pass_equals_the_steps_on_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same_both_ways(spark, [row.text for row in docs.select("text").collect()])


def test_long_runs_need_no_stack(spark):
    numbers = " ".join(str(n) for n in range(60_000)) + " word " + "x" * 200_000
    assert one(spark, numbers, lambda c: text.clean_text(c, STOP)) == "word " + "x" * 200_000


def test_cleaning_is_idempotent(spark, sf_dir):
    words = text.default_stop_words()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = docs.select(text.clean_text(F.col("text"), words).alias("once"))
    assert once.where(text.clean_text(F.col("once"), words) != F.col("once")).count() == 0


def test_unknown_pattern(spark):
    with pytest.raises(ValueError):
        text.remove_pattern(F.col("text"), "emoji")


@pytest.mark.parametrize(
    "word,base",
    [("cities", "city"), ("ties", "tie"), ("classes", "class"), ("boxes", "box"), ("games", "game"),
     ("glass", "glass"), ("bus", "bus"), ("basis", "basis"), ("gas", "gas"), ("running", "run"),
     ("planned", "plan"), ("playing", "play"), ("matched", "match"), ("racing", "race"),
     ("rated", "rate"), ("thing", "thing"), ("need", "need"), ("seeing", "see"), ("chess", "chess"),
     ("passing", "pass"), ("b2b4c", "b2b4c"), ("", "")],
)
def test_lemma(spark, word, base):
    assert one(spark, word, lemma) == base


@pytest.mark.parametrize(
    "raw,pieces",
    [("a,b,,", ["a", "b"]), (",a", ["", "a"]), (",,,", []), ("", [""]), ("a", ["a"]), (None, None)],
)
def test_comma_pieces(spark, raw, pieces):
    assert one(spark, raw, text.comma_pieces) == pieces


def test_stop_pieces_only_as_a_whole(spark):
    kept = one(spark, "The,the cat, the,dog", lambda c: text.drop_stop_pieces(text.comma_pieces(c), STOP))
    assert kept == ["the cat", " the", "dog"]


@pytest.mark.parametrize("raw,words", [("", [""]), ("A b", ["a", "b"]), ("a  b", ["a", "", "b"])])
def test_tokens(spark, raw, words):
    assert one(spark, raw, text.tokens) == words


def test_predicates(spark):
    assert one(spark, "plain ~\x7f", text.is_ascii) is True
    assert one(spark, "café", text.is_ascii) is False
    assert one(spark, None, text.is_ascii) is None
    assert one(spark, "the and of", text.has_allowed_characters) is True
    assert one(spark, "a, b", text.has_allowed_characters) is False
    assert one(spark, "café naïve", text.strip_non_ascii) == "caf nave"
    assert one(spark, "a\nb\tc", text.strip_control_characters) == "abc"


def test_empty_text_is_one_empty_token(spark):
    assert one(spark, "the", lambda c: text.preprocessed_tokens(c, STOP)) == [""]
    assert one(spark, None, lambda c: text.preprocessed_tokens(c, STOP)) is None


def test_rules_hold_at_the_true_end_of_a_text(spark):
    rows = [("a,\n",), (",,\n",), (",,",), ("",), ("a,,",), ("abc\n",), ("abc",)]
    got = spark.createDataFrame(rows, "t string").select(
        text.comma_pieces(F.col("t")), text.has_allowed_characters(F.col("t"))
    ).collect()
    assert [row[0] for row in got] == [["a", "\n"], ["", "", "\n"], [], [""], ["a"], ["abc\n"], ["abc"]]
    assert [row[1] for row in got][-2:] == [False, True]

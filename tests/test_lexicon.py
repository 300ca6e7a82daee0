import pytest
from pyspark.sql import functions as F

from tagloom.operators import bloom, hotkeys, lexicon, packed

DOCS = [(1, "big cats run big"), (2, "cats"), (3, ""), (4, None), (5, "a  b "), (6, "unknown words")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string")


def as_dict(df):
    rows = df.collect()
    result = {row[0]: row[1] for row in rows}
    assert len(result) == len(rows)
    return result


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_replace(spark, docs, broadcast_bytes):
    entries = spark.createDataFrame([("big", "large"), ("cats", "cat")], "word string, value string")
    replaced = lexicon.replace_words(docs, "id", "text", entries, broadcast_bytes=broadcast_bytes)
    assert as_dict(replaced) == {
        1: "large cat run large", 2: "cat", 3: "", 4: None, 5: "a  b", 6: "unknown words"
    }


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_repeated_and_missing_ids(spark, broadcast_bytes):
    rows = [(1, "a b"), (1, "a c"), (1, "a c"), (None, "a"), (None, None)]
    docs = spark.createDataFrame(rows, "id int, text string")
    entries = spark.createDataFrame([("a", "X")], "word string, value string")
    replaced = lexicon.replace_words(docs, "id", "text", entries, broadcast_bytes=broadcast_bytes)
    assert sorted((row.id or 0, row.replaced or "") for row in replaced.collect()) == [
        (0, ""), (0, "X"), (1, "X b"), (1, "X c"), (1, "X c")
    ]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_annotate(spark, docs, broadcast_bytes):
    tags = spark.createDataFrame([("big", "JJ"), ("cats", "NNS"), ("cats", "NNS")], "word string, tag string")
    tagged = lexicon.annotate_words(docs.where("id <= 2"), "id", "text", tags, "NN", broadcast_bytes=broadcast_bytes)
    assert as_dict(tagged) == {1: "big|JJ,cats|NNS,run|NN,big|JJ", 2: "cats|NNS"}


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_lexicon_before_rules(spark, docs, broadcast_bytes):
    listed = spark.createDataFrame([("big", "huge")], "word string, lemma string")
    out = lexicon.lemmatize_by_lexicon(docs, "id", "text", listed, broadcast_bytes=broadcast_bytes)
    assert as_dict(out)[1] == "huge cat run huge"


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_drop_listed(spark, docs, broadcast_bytes):
    listed = spark.createDataFrame([("big",), ("run",)], "word string")
    out = lexicon.drop_words_by_table(docs, "id", "text", listed, broadcast_bytes=broadcast_bytes)
    assert as_dict(out) == {1: "cats", 2: "cats", 3: "", 4: None, 5: "a b", 6: "unknown words"}


def test_most_frequent_tag(spark):
    rows = [("x", "B"), ("x", "B"), ("x", "A"), ("y", "B"), ("y", "A")]
    tagged = spark.createDataFrame(rows, "w string, t string")
    assert as_dict(lexicon.most_frequent_tags(tagged, "w", "t")) == {"x": "B", "y": "A"}


def test_vocabulary(spark):
    docs = spark.createDataFrame([(["cats", "cats", "run"],), (None,)], "tokens array<string>")
    assert as_dict(lexicon.vocabulary_lemmas(docs)) == {"cats": "cat", "run": "run"}
    assert lexicon.vocabulary(docs).where(F.col("word").isNull()).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_long_and_null_values(spark, broadcast_bytes):
    words = [f"w{i % 700}" for i in range(5000)]
    rows = [("long", " ".join(words)), ("blank", "   "), (None, "w1"), ("same", "w1"), ("same", "w1")]
    docs = spark.createDataFrame(rows, "id string, text string")
    entries = spark.createDataFrame([(f"w{i}", f"v{i}") for i in range(0, 700, 2)] + [(None, "x"), ("w3", None)],
                                    "word string, value string")
    got = lexicon.replace_words(docs, "id", "text", entries, broadcast_bytes=broadcast_bytes).collect()
    expected = " ".join(w if int(w[1:]) % 2 else "v" + w[1:] for w in words)
    assert sorted((r.id or "", r.replaced) for r in got) == [
        ("", "w1"), ("blank", ""), ("long", expected), ("same", "w1"), ("same", "w1")
    ]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_no_row_per_word_is_shuffled(spark, broadcast_bytes):
    """Rows written to exchanges: those of texts and pieces, and of the listed words, not of all words."""
    rows = [(i, " ".join(["filler%d" % (i * k % 997) for k in range(200)] + ["listed"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(4)
    entries = spark.createDataFrame([("listed", "X")], "word string, value string")
    out = lexicon.replace_words(docs, "id", "text", entries, broadcast_bytes=broadcast_bytes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("_position" not in line for line in shuffled)
    if broadcast_bytes:
        assert not [line for line in shuffled if "hashpartitioning(word" in line]
    assert {r.replaced.split()[-1] for r in out.collect()} == {"X"}


def test_bloom_filter_never_drops_a_listed_word(spark):
    listed = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("word"))
    for bits in (1 << 27, 64):
        found = bloom.bloom_filter(listed, max_bits=bits)
        assert listed.where(~found.may_contain(F.col("word"))).count() == 0
    found = bloom.bloom_filter(listed)
    others = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("word"))
    assert others.where(found.may_contain(F.col("word"))).count() < 1600
    empty = bloom.bloom_filter(listed.where("false"))
    assert listed.where(empty.may_contain(F.col("word"))).count() == 0
    nothing = spark.createDataFrame([(None,)], "word string")
    assert nothing.where(found.may_contain(F.col("word")).isNull()).count() == 0


def test_a_table_that_fits_moves_no_text(spark, docs):
    entries = spark.createDataFrame([("big", "large"), ("cats", "cat")], "word string, value string")
    plan = lexicon.replace_words(docs, "id", "text", entries)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "Join" not in plan


def test_only_words_beyond_the_commonest_are_joined(spark, monkeypatch):
    """1,000 entries of which room is for a tenth: rows to join are those of the rarer words."""
    joined = []

    def counted(found, entries, *rest):
        joined.append((found.count(), entries.count()))
        return hotkeys.join_entries(found, entries, *rest)

    monkeypatch.setattr(lexicon, "join_entries", counted)
    rows = [(i, " ".join([f"often{k}" for k in range(50)] + [f"rare{i}"])) for i in range(950)]
    docs = spark.createDataFrame(rows, "id int, text string")
    words = [f"often{k}" for k in range(50)] + [f"rare{i}" for i in range(950)]
    entries = spark.createDataFrame([(w, w.upper()) for w in words], "word string, value string")
    out = lexicon.replace_words(docs, "id", "text", entries, broadcast_bytes=25_000)
    assert as_dict(out) == {i: text.upper() for i, text in rows}
    assert joined == [(950, 950)]
    # The common words are part of an expression, not a column of the rows.
    assert "_packed" not in out._jdf.queryExecution().executedPlan().toString()


def test_packed_table(spark):
    written = spark.createDataFrame([(f"w{i}", i) for i in range(1000)] + [("null", None)], "word string, _value int")
    table = packed.pack(written)
    words = spark.createDataFrame([(f"w{i}",) for i in range(0, 2000, 7)] + [("null",), (None,), ("",)], "word string")
    found = table.select(words, ["word"], lambda value_of: F.array(value_of(F.col("word"))), "found")
    got = {r.word: r.found[0] for r in found.collect()}
    assert got == {f"w{i}": i if i < 1000 else None for i in range(0, 2000, 7)} | {"null": None, None: None, "": None}
    nothing = packed.pack(written.where("false"))
    found = nothing.select(words, ["word"], lambda value_of: F.array(value_of(F.col("word"))), "found")
    assert {r.found[0] for r in found.collect()} == {None}
    assert "_packed" not in found._jdf.queryExecution().executedPlan().toString()

"""The sequence tagger against all paths, base forms by tag against plain Python."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.catalog import _in_training, _tagged_words
from tagloom.functions import text
from tagloom.functions.lemma import lemma
from tagloom.operators import evaluate, taglemma, tagger


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=5), st.integers(1, 3), st.integers(0, 10**9))
def test_viterbi_equals_all_paths(lengths, tags, seed):
    rng = np.random.default_rng(seed)
    scores = rng.integers(-3, 1, (sum(lengths), tags))
    start, moves = rng.integers(-3, 1, tags), rng.integers(-3, 1, (tags, tags))
    got = tagger.viterbi(scores, np.array(lengths, np.int64), start, moves)
    at = 0
    for n in lengths:
        def score(path):
            steps = sum(moves[a, b] for a, b in zip(path, path[1:]))
            return (start[path[0]] if n else 0) + steps + sum(scores[at + i, t] for i, t in enumerate(path))

        best = max(map(score, itertools.product(range(tags), repeat=n)))
        assert score(tuple(got[at : at + n])) == best
        at += n


def test_equal_paths_take_the_lower_tag():
    zero = np.zeros((3, 2), np.int64)
    assert list(tagger.viterbi(zero, np.array([3]), zero[0], zero[:2])) == [0, 0, 0]


@pytest.fixture(scope="module")
def model(spark):
    rows = [
        (["the", "duck", "swims"], ["DT", "NN", "VB"]),
        (["the", "dog", "barks"], ["DT", "NN", "VB"]),
        (["they", "duck"], ["PR", "VB"]),
        (["they", "duck", None], ["PR", "VB", "VB"]),
        ([], []),
        (None, None),
    ]
    return tagger.fit(spark.createDataFrame(rows, "words array<string>, tags array<string>"))


def tagged(spark, model, rows, **how):
    docs = spark.createDataFrame(rows, "id string, text string, tags string, word string, _value int")
    return sorted(((r.id or "", r.tags) for r in tagger.tag_sequence(docs, model, "id", "text", **how).collect()), key=str)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_context_decides(spark, model, broadcast_bytes):
    rows = [("a", "the duck barks"), ("b", "they duck"), ("c", None), ("d", ""), ("e", "the cat whistles"), (None, "duck"), ("a", "the duck barks")]
    got = tagged(spark, model, [(*r, "clash", "", 1) for r in rows], broadcast_bytes=broadcast_bytes)
    assert [g for g in got if g[0] == "a"] == [("a", "DT NN VB")] * 2
    assert ("b", "PR VB") in got and ("c", None) in got and ("e", "DT NN VB") in got
    assert len(got) == 7 and len(dict(got)["d"].split()) == 1


def test_very_long_text(spark, model):
    got = tagged(spark, model, [("long", "the duck barks " * 20_000, "", "", 0)])
    assert got == [("long", " ".join(["DT NN VB"] * 20_000))]


def test_no_texts(spark, model):
    assert tagged(spark, model, []) == []
    with pytest.raises(ValueError):
        tagger.fit(spark.createDataFrame([([], [])], "words array<string>, tags array<string>"))


def test_beats_the_commonest_tag_on_held_out_texts(spark):
    """Texts that change their language in the middle: words that several languages share need context."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "doc_id", F.upper("lang").alias("lang"), F.slice(text.clean_words(F.col("text"), []), 1, 300).alias("words")
    )
    model = tagger.fit(tagger.tagged_rows(_in_training(docs), F.col("words"), F.col("lang")))
    held_out = docs.where(~evaluate.in_training_part(F.col("doc_id")) & (F.size("words") > 0))
    joined = held_out.select("doc_id", F.array_join("words", " ").alias("text"))
    found = {r.doc_id: r.tags.split(" ") for r in tagger.tag_sequence(joined, model, "doc_id", "text").collect()}
    training = _in_training(docs).select(F.explode("words").alias("w"), "lang").groupBy("w", "lang").count().collect()
    votes = defaultdict(Counter)
    for row in training:
        votes[row.w][row.lang] += row["count"]
    right = plain = total = 0
    for row in held_out.collect():
        for word, tag in zip(row.words, found[row.doc_id], strict=True):
            commonest = votes[word].most_common(1)[0][0] if word in votes else "EN"
            right, plain, total = right + (tag == row.lang), plain + (commonest == row.lang), total + 1
    assert right / total > 0.99 and right > plain + 0.02 * total


# --- base forms by tag -------------------------------------------------------------------


def plain_lemmas(listed, pairs):
    def nodes(word):
        for n in range(min(len(word), taglemma.LONGEST) + 1):
            yield n, word[len(word) - n :]
        yield taglemma.LONGEST + 1, "^" + word

    votes = defaultdict(Counter)
    for word, tag, base in listed:
        same = 0
        while same < min(len(word), len(base)) and word[same] == base[same]:
            same += 1
        for depth, ending in nodes(word):
            votes[tag, depth, ending][len(word) - same, base[same:]] += 1
    trie = {
        node: min(c, key=lambda s: (-c[s], *s))
        for node, c in votes.items()
        if sum(c.values()) >= taglemma.SUPPORT or node[1] in (0, taglemma.LONGEST + 1)
    }
    out = {}
    for word, tag in pairs:
        scripts = [trie[tag, d, e] for d, e in nodes(word) if (tag, d, e) in trie]
        cut, add = scripts[-1] if scripts else (0, "")
        out[word, tag] = word[: len(word) - cut] + add if cut <= len(word) else word
    return out


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_lemmas_equal_plain_votes(spark, broadcast_bytes):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcde", k=rng.randrange(1, 6))) for _ in range(60)]
    listed = {(s + e, tag): (s + e, tag, s + f) for s in stems for e, f, tag in
              [("ing", "", "VB"), ("ies", "y", "NN"), ("s", "", "NN"), ("ed", "e", "VB"), ("", "", "JJ"), ("en", "", "VB")]}
    rows = sorted(listed.values())
    pairs = [(s + e, tag) for s in ["xyz", "a", "", "b"] for e in ["ing", "ies", "s", "ed", "n", ""] for tag in ["VB", "NN", "ZZ"]]
    pairs += [(w, t) for w, t, _ in rows[::3]]
    trie = taglemma.learn(spark.createDataFrame(rows + rows[:9] + [(None, "NN", "x"), ("q", "NN", None)], "word string, tag string, lemma string"))
    df = spark.createDataFrame(pairs + pairs[:5] + [(None, "NN"), ("loose", None)], "word string, tag string")
    got = {(r.word, r.tag): r.lemma for r in taglemma.lemmatize_tagged(df, trie, broadcast_bytes).collect()}
    assert got.pop(("loose", None)) == "loose"
    assert got == plain_lemmas(rows, pairs)


def test_learnt_lemmas_agree_with_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "lang", text.clean_text(F.col("text"), []).alias("cleaned")
    )
    words = _tagged_words(docs).where("tag = 'EN'")
    listed = words.where(evaluate.in_training_part(F.col("word"))).withColumn("lemma", lemma(F.col("word")))
    learnt = taglemma.lemmatize_tagged(words.where(~evaluate.in_training_part(F.col("word"))), taglemma.learn(listed))
    row = learnt.agg(
        F.avg((F.col("lemma") == lemma(F.col("word"))).cast("int")).alias("agree"),
        F.avg((F.col("word") == lemma(F.col("word"))).cast("int")).alias("unchanged"),
    ).first()
    print(f"agreement {row.agree:.4f}, words that the rules leave {row.unchanged:.4f}")
    assert row.agree > 0.97 and row.agree > row.unchanged

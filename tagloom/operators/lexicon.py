"""Word-by-word work against a table: replace, tag, lemmatize by lexicon, drop listed words.

A table that fits is packed into one row, and texts are answered where they stand. Of a larger one that row has
the entries of the words commonest in the texts. Of the other words the distinct ones of a text are looked
up, piece by piece, and only those that the table lists are joined. The entries of a piece come back as one map, and
the words of the text are replaced through it in an array expression: texts are shuffled once, and a row per
word only for the rarer words. Maps belong to a record's id and a hash of its text: records may share an id or
have none, and all are answered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lemma import lemma
from tagloom.functions.text import explode_once, text_key
from tagloom.operators.hotkeys import common_entries, join_entries
from tagloom.operators.packed import pack
from tagloom.shared import BROADCAST_BYTES, ROW_BYTES, materialize

# Words that share a map: looking one up compares it with the others, so a map stays short.
PIECE_WORDS = 64


def replace_words(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lexicon: DataFrame,
    out_col: str = "replaced",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each word with an entry in ``lexicon(word, value)`` becomes its value, others stay."""
    return _rebuild(
        docs, id_col, text_col, lexicon, "value", out_col, " ", broadcast_bytes,
        lambda word, value: F.coalesce(value, word),
    )


def annotate_words(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lexicon: DataFrame,
    default_tag: str,
    out_col: str = "annotated",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``word|TAG`` joined by commas, tags from ``lexicon(word, tag)``."""
    return _rebuild(
        docs, id_col, text_col, lexicon, "tag", out_col, ",", broadcast_bytes,
        lambda word, tag: F.concat(word, F.lit("|"), F.coalesce(tag, F.lit(default_tag))),
    )


def lemmatize_by_lexicon(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lexicon: DataFrame,
    out_col: str = "lemmas",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The lemma from ``lexicon(word, lemma)`` where it has one, else from the suffix rules."""
    return _rebuild(
        docs, id_col, text_col, lexicon, "lemma", out_col, " ", broadcast_bytes,
        lambda word, listed: F.coalesce(listed, lemma(word)),
    )


def drop_words_by_table(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    words: DataFrame,
    out_col: str = "kept",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Drop the words listed in ``words(word)``, for lists too long for an expression."""
    listed = words.select("word", F.lit("").alias("listed"))
    return _rebuild(
        docs, id_col, text_col, listed, "listed", out_col, " ", broadcast_bytes,
        lambda word, found: F.when(found.isNull() & (word != ""), word),
    )


def most_frequent_tags(tagged: DataFrame, word_col: str, tag_col: str) -> DataFrame:
    """``(word, tag)``: the tag a word carries most often; the first by name among equals."""
    counts = tagged.groupBy(F.col(word_col).alias("word"), F.col(tag_col).alias("tag")).agg(
        F.count(F.lit(1)).alias("n")
    )
    first = F.min(F.struct((-F.col("n")).alias("rank"), F.col("tag").alias("tag")))
    return counts.groupBy("word").agg(first.alias("best")).select("word", "best.tag")


def vocabulary(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Distinct tokens of a corpus as ``word``."""
    words = docs.select(explode_once(F.col(tokens_col)).alias("word"))
    return words.where(F.col("word").isNotNull()).distinct()


def vocabulary_lemmas(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(word, lemma)`` of every distinct token: the rules run once per word of the corpus."""
    return vocabulary(docs, tokens_col).withColumn("lemma", lemma(F.col("word")))


def _rebuild(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lexicon: DataFrame,
    value_col: str,
    out_col: str,
    separator: str,
    broadcast_bytes: int,
    render: Callable[[Column, Column], Column],
) -> DataFrame:
    # One entry per word, so that a repeated entry cannot multiply words.
    entries = materialize(
        lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.min(value_col).alias("_value")),
        "lexicon",
    )
    # Words rendered as NULL are dropped by the join of the strings.
    looked_up = look_up(docs, id_col, text_col, entries, render, broadcast_bytes)
    return looked_up.select(id_col, F.array_join("_out", separator).alias(out_col))


def look_up(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    entries: DataFrame,
    render: Callable[[Column, Column], Column],
    broadcast_bytes: int = BROADCAST_BYTES,
    row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """``(id, _text, _out)``: for every word of the text what ``render(word, value)`` makes of its entry.

    ``entries(word, _value)``, a written table, has one row a word; the value of an unlisted word is NULL.
    """
    near, far = common_entries(
        entries, docs.select(explode_once(_words(F.col(text_col))).alias("word")), broadcast_bytes // 2, row_bytes
    )
    packed = pack(near)
    if far is None:
        rows = docs.select(id_col, F.col(text_col).alias("_text"))
        whole = _words(F.col("_text"))
        return packed.select(
            rows, [id_col, "_text"], lambda value_of: F.transform(whole, lambda word: render(word, value_of(word))), "_out"
        )
    record = [id_col, "_key_a", "_key_b"]
    keyed = docs.select(id_col, F.col(text_col).alias("_text"), *text_key(F.col(text_col)))
    # Outer forms and filters after them: see ``explode_once``.
    pieces = keyed.select(*record, F.posexplode_outer(_pieces(F.col("_text"))).alias("_piece", "_words"))
    others = packed.select(
        pieces, [*record, "_piece"], lambda value_of: F.filter("_words", lambda word: value_of(word).isNull()), "_others"
    )
    found = others.select(*record, "_piece", explode_once(F.array_distinct("_others")).alias("word"))
    hits = join_entries(found.where(F.col("word").isNotNull()), far, broadcast_bytes, row_bytes)
    # Combined where they were found: rows of pieces and records are shuffled, not of words.
    listed = F.map_from_entries(F.collect_set(F.struct("word", "_value")))
    of_piece = hits.groupBy(*record, "_piece").agg(listed.alias("_listed"))
    of_record = of_piece.groupBy(*record).agg(
        F.map_from_entries(F.collect_list(F.struct("_piece", "_listed"))).alias("_maps")
    ).select(F.col(id_col).alias("_id"), F.col("_key_a").alias("_a"), F.col("_key_b").alias("_b"), "_maps")
    same = (
        F.col(id_col).eqNullSafe(F.col("_id"))
        & (F.col("_key_a") == F.col("_a"))
        & (F.col("_key_b") == F.col("_b"))
    )

    def rendered(value_of: Callable[[Column], Column]) -> Column:
        def of_words(words: Column, piece: Column) -> Column:
            # An array of one element binds the map once for all words of the piece.
            own = F.array(F.element_at("_maps", piece))
            return F.flatten(F.transform(own, lambda values: F.transform(words, lambda word: of_word(word, values))))

        def of_word(word: Column, values: Column) -> Column:
            return render(word, F.coalesce(value_of(word), F.element_at(values, word)))

        return F.flatten(F.transform(_pieces(F.col("_text")), of_words))

    return packed.select(keyed.join(of_record, same, "left"), [id_col, "_text"], rendered, "_out")


def _words(text: Column) -> Column:
    return F.split(F.rtrim(text, F.lit(" ")), " ")


def _pieces(text: Column) -> Column:
    """The words of a text as arrays of at most ``PIECE_WORDS``; NULL for a NULL text."""
    words = F.array(_words(text))

    def cut(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / PIECE_WORDS).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * PIECE_WORDS + 1, PIECE_WORDS)
        )

    return F.when(text.isNotNull(), F.flatten(F.transform(words, cut)))

"""Multinomial Naive Bayes over any ``(id, tokens, label)`` table, as joins and aggregates.

The fit is one aggregation of ``(label, term)``. Scoring joins the tokens with the model's
terms and adds up one row per record:

    score(d, c) = prior(c) + len(d) * base(c) + sum over tokens w of ln((n(c,w) + s) / s)
    prior(c)    = ln((docs(c) + s) / (docs + classes * s))
    base(c)     = ln(s / (tokens(c) + s * features))

A term the class has not seen adds nothing to the sum; ``len * base`` covers it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.patterns import HASH_BUCKETS, SMOOTHING
from tagloom.functions.ranking import index_of
from tagloom.functions.text import explode_once, text_key
from tagloom.operators.bloom import bloom_filter
from tagloom.shared import BROADCAST_BYTES, ROW_BYTES, broadcast_size, materialize

# Up to so many classes have a sum each in generated code; of more, terms are postings of the classes
# that have seen them and sums are rows. Both ways give the same scores.
CLASS_COLUMNS = 100
# Bytes of a posting, and classes that are put in order together.
POSTING_BYTES = 16
CLASS_BLOCK = 64
# The commonest words of the scored records that are looked for, the items their sketch tracks, and the
# groups that a shuffle partition gets if no word is more common than the others.
HEAVY_WORDS = 1024
# Terms with at least so many uses in training are told apart no further when the commonest are chosen.
COMMON_USES = 4096
TRACKED_WORDS = 1 << 16
GROUPS = 4

TERMS_SCHEMA = "label string, term string, n bigint"


@dataclass(frozen=True)
class ClassStats:
    label: str
    docs: int
    tokens: int
    terms: int
    term_bytes: int


@dataclass(frozen=True)
class BayesModel:
    """``counts`` is a written table ``(label, term, n)``; NULL terms hold the document counts."""

    counts: DataFrame
    classes: tuple[ClassStats, ...]
    smoothing: float
    features: int
    uniform_priors: bool = False

    @property
    def labels(self) -> list[str]:
        """Class labels in index order: most documents first, then by name."""
        return [stats.label for stats in self.classes]

    def prior(self, index: int) -> float:
        if self.uniform_priors:
            return -log(len(self.classes))
        docs = sum(stats.docs for stats in self.classes)
        s = self.smoothing
        return log((self.classes[index].docs + s) / (docs + len(self.classes) * s))

    def base(self, index: int) -> float:
        s = self.smoothing
        return log(s / (self.classes[index].tokens + s * self.features))

    def term_rows(self) -> DataFrame:
        return self.counts.where(F.col("term").isNotNull())

    def term_probabilities(self) -> DataFrame:
        """``(label, term, n, log_prob)`` of every term seen in a class."""
        s = self.smoothing
        norms = F.lit([float(stats.tokens + s * self.features) for stats in self.classes])
        norm = F.get(norms, index_of(F.col("label"), self.labels))
        return self.term_rows().withColumn("log_prob", F.log((F.col("n") + F.lit(s)) / norm))

    def term_weights(self) -> DataFrame:
        """``(term, total, weights)``: one row per term, a weight per class in index order."""
        s, classes = self.smoothing, range(len(self.classes))
        indexed = self.term_rows().select(
            "term", "n", index_of(F.col("label"), self.labels).alias("label_idx")
        )
        per_class = [F.expr(f"sum(if(label_idx = {i}, n, 0)) AS n{i}") for i in classes]
        grouped = indexed.groupBy("term").agg(F.sum("n").alias("total"), *per_class)
        weights = ", ".join(f"ln((n{i} + {s!r}D) / {s!r}D)" for i in classes)
        return grouped.selectExpr("term", "total", f"array({weights}) AS weights")

    def term_postings(self) -> DataFrame:
        """``(term, total, weights)``: only classes that have seen the term, as ``(_class, _weight)``.

        A row has as many entries as the model has for the term, however many classes there are.
        """
        spark = self.counts.sparkSession
        # As long as the class statistics that the driver holds.
        names = spark.createDataFrame(list(enumerate(self.labels)), "_class int, label string")
        s = self.smoothing
        weight = F.log((F.col("n") + F.lit(s)) / F.lit(s)).alias("_weight")
        indexed = self.term_rows().join(F.broadcast(names), "label")
        return indexed.groupBy("term").agg(
            F.sum("n").alias("total"), F.collect_list(F.struct("_class", weight)).alias("weights")
        )

    def save(self, path: str) -> None:
        """Counts as Parquet, class statistics and settings as one small JSON row."""
        settings = {
            "classes": [vars(stats) for stats in self.classes],
            "smoothing": self.smoothing,
            "features": self.features,
            "uniform_priors": self.uniform_priors,
        }
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        spark = self.counts.sparkSession
        spark.createDataFrame([(json.dumps(settings),)], "value string").write.mode(
            "overwrite"
        ).text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BayesModel:
        settings = json.loads(spark.read.text(f"{path}/settings").first().value)
        settings["classes"] = tuple(ClassStats(**stats) for stats in settings["classes"])
        counts = spark.read.schema(TERMS_SCHEMA).parquet(f"{path}/counts")
        return cls(counts=counts, **settings)


def fit(
    docs: DataFrame,
    label_col: str,
    tokens_col: str = "tokens",
    smoothing: float = SMOOTHING,
    features: int = HASH_BUCKETS,
    uniform_priors: bool = False,
) -> BayesModel:
    """Count terms per class in one pass over the documents.

    Every document adds one NULL term next to its tokens, so the same aggregation, combined
    on the map side, also counts the documents. Rows without a label teach nothing; a NULL
    token array counts as a document without words.
    """
    marker = F.array(F.lit(None).cast("string"))
    exploded = docs.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"),
        explode_once(F.concat(marker, F.col(tokens_col))).alias("term"),
    )
    return fit_counts(
        exploded.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n")), smoothing, features, uniform_priors
    )


def fit_counts(
    counts: DataFrame,
    smoothing: float = SMOOTHING,
    features: int = HASH_BUCKETS,
    uniform_priors: bool = False,
) -> BayesModel:
    """The model of ``counts(label, term, n)``, one row a label and term; NULL terms hold the document counts."""
    counts = materialize(counts, "bayes-counts")
    return BayesModel(counts, _class_stats(counts), smoothing, features, uniform_priors)


def _class_stats(counts: DataFrame) -> tuple[ClassStats, ...]:
    is_term = F.col("term").isNotNull()
    rows = (
        counts.groupBy("label")
        .agg(
            F.sum(F.when(~is_term, F.col("n")).otherwise(0)).alias("docs"),
            F.sum(F.when(is_term, F.col("n")).otherwise(0)).alias("tokens"),
            F.count("term").alias("terms"),
            F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("term_bytes"),
        )
        .collect()
    )
    if not rows:
        raise ValueError("no labelled document to learn from")
    ordered = sorted(rows, key=lambda row: (-row.docs, row.label))
    return tuple(ClassStats(**row.asDict(recursive=True)) for row in ordered)


def class_scores(
    docs: DataFrame,
    model: BayesModel,
    id_col: str,
    tokens_col: str = "tokens",
    carry: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    written: bool = False,
) -> DataFrame:
    """``(id, *carry, scores)``: the raw scores of every record in label order.

    One row comes out for every record. Ids may repeat or be NULL: records are told apart by
    id, carried values and a 128-bit hash of their tokens, and those that agree in all of it
    are counted and answered as often. ``carry`` names columns to keep. A record without
    tokens counts as one unknown word.

    A model within ``broadcast_bytes`` is joined on the map side, and each record is added up
    where it was read: one small row per record is shuffled. Of a larger model the weights of the terms that
    were commonest in training are broadcast, as many as fit half of that. Of the other words a Bloom filter
    rules out those that the model does not know; the rest are written, a sketch finds those that are common
    in these records, whose weights are broadcast too, as many as fit the other half, and the others are
    shuffled; a common word that did not fit is spread over as many groups as its estimated count asks for.
    ``written`` says that reading the tokens twice is cheap.
    """
    size = len(model.classes)
    sparse = size > CLASS_COLUMNS
    weights = model.term_postings() if sparse else model.term_weights()
    row_bytes = ROW_BYTES + (POSTING_BYTES if sparse else 8 * size)
    # Terms counted once per class they occur in: too high, but known from the fit.
    small = sum(c.terms * row_bytes + c.term_bytes for c in model.classes) <= broadcast_bytes
    summed = sum_weights(docs, weights, size, id_col, tokens_col, carry, broadcast_bytes, small, sparse, written)
    keep = [id_col, *carry]
    scored = summed.select(*keep, "_copies", _scores(model).alias("scores"))
    # One row for each of the records that agree.
    each = scored.select(*keep, "scores", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return each.select(*keep, "scores")


def sum_weights(
    docs: DataFrame,
    weights: DataFrame,
    size: int,
    id_col: str,
    tokens_col: str,
    carry: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    small: bool = False,
    sparse: bool = False,
    written: bool = False,
) -> DataFrame:
    """``(id, *carry, _length, _copies, _sums)``: the summed ``weights(term, weights)`` of each record's tokens.

    Records that agree in all of it are one row with their number in ``_copies``; the sums are over all
    of them. ``small`` says that the table is known to fit the limit; otherwise it is written and measured.
    """
    keep = [id_col, *carry]
    record = [*keep, "_words_a", "_words_b", "_length"]
    docs = docs.select(
        *keep,
        *text_key(F.col(tokens_col), "_words"),
        F.greatest(F.coalesce(F.size(tokens_col), F.lit(1)), F.lit(1)).alias("_length"),
        F.col(tokens_col).alias("_tokens"),
    )
    if not small:
        weights = materialize(weights, "bayes-weights")
        small = _bytes(weights, sparse, size) <= broadcast_bytes
    if small:
        hits = _words(docs, record).join(F.broadcast(weights), "term", "left")
    else:
        # Both halves of the join read the tokens: clean the texts once.
        words = _words(docs if written else materialize(docs, "score-tokens"), record)
        hits = _split_join(words, weights, id_col, broadcast_bytes, sparse, size)
    return _sparse_sums(hits, record, size) if sparse else _dense_sums(hits, record, size)


def _words(docs: DataFrame, record: Sequence[str]) -> DataFrame:
    """One row per word; ``_first`` marks exactly one row of every record."""
    words = docs.select(*record, F.posexplode_outer("_tokens").alias("_position", "term"))
    return words.withColumn("_first", F.coalesce(F.col("_position") == 0, F.lit(True)))


def _bytes(weights: DataFrame, sparse: bool, size: int) -> int:
    """What broadcasting written weights takes."""
    if not sparse:
        return broadcast_size(weights, "term", row_bytes=8 * size + ROW_BYTES)
    entries = weights.agg(F.coalesce(F.sum(F.size("weights")), F.lit(0)).alias("n")).first().n
    return broadcast_size(weights, "term") + POSTING_BYTES * entries


def _dense_sums(hits: DataFrame, record: Sequence[str], size: int) -> DataFrame:
    """``(*record, _copies, _sums)`` from dense weights: one sum per class in generated code."""
    copies = F.sum(F.col("_first").cast("long")).alias("_copies")
    sums = [F.expr(f"sum(weights[{i}]) AS _s{i}") for i in range(size)]
    return hits.groupBy(*record).agg(copies, *sums).withColumn(
        "_sums", F.array(*[F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(size)])
    )


def _sparse_sums(hits: DataFrame, record: Sequence[str], size: int) -> DataFrame:
    """``(*record, _copies, _sums)`` from postings: rows in proportion to the entries of the words.

    Class -1 counts the records that agree. Sums are put in order in blocks of classes, so that
    looking one up compares it with the few of its block.
    """
    one = F.array(F.struct(F.lit(-1).alias("_class"), F.lit(1.0).alias("_weight")))
    known = F.coalesce("weights", F.array().cast("array<struct<_class:int,_weight:double>>"))
    posted = F.when(F.col("_first"), F.concat(one, known)).otherwise(known)
    # The outer form, see ``explode_once``; words without entries leave a row that the filter drops.
    rows = hits.select(*record, F.inline_outer(posted)).where(F.col("_class").isNotNull())
    summed = rows.groupBy(*record, "_class").agg(F.sum("_weight").alias("_sum"))
    block = F.floor(F.col("_class") / CLASS_BLOCK).cast("int").alias("_block")
    blocks = summed.groupBy(*record, block).agg(
        F.map_from_entries(F.collect_list(F.struct("_class", "_sum"))).alias("_in_block")
    )
    whole = blocks.groupBy(*record).agg(
        F.map_from_entries(F.collect_list(F.struct("_block", "_in_block"))).alias("_blocks")
    )

    def dense(block: Column) -> Column:
        last = F.least(block * CLASS_BLOCK + (CLASS_BLOCK - 1), F.lit(size - 1))
        classes = F.sequence(block * CLASS_BLOCK, last)
        own = F.array(F.element_at("_blocks", block))
        return F.flatten(
            F.transform(
                own,
                lambda sums: F.transform(classes, lambda c: F.coalesce(F.element_at(sums, c), F.lit(0.0))),
            )
        )

    blocks_of = F.sequence(F.lit(0), F.lit((size - 1) // CLASS_BLOCK))
    copies = F.element_at(F.element_at("_blocks", F.lit(-1)), F.lit(-1)).cast("long")
    return whole.select(
        *record, copies.alias("_copies"), F.flatten(F.transform(blocks_of, dense)).alias("_sums")
    )


def heavy_words(words: DataFrame, weights_bytes: int, broadcast_bytes: int) -> DataFrame:
    """``(term, salts)`` of the words that would fill a task, at most ``HEAVY_WORDS`` of them.

    A mergeable sketch of frequent items estimates their counts in one pass. The commonest, as many as
    fit the limit at ``weights_bytes`` each, have 0 salts, which stands for broadcasting them; each of
    the others gets so many that a salt has about as many rows as a group of its share.
    """
    found = words.where(F.col("term").isNotNull()).agg(
        F.call_function(
            "approx_top_k", F.col("term"), F.lit(HEAVY_WORDS), F.lit(TRACKED_WORDS)
        ).alias("top"),
        F.count("term").alias("n"),
    ).first()
    spark = words.sparkSession
    groups = GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    room = broadcast_bytes // max(1, weights_bytes)
    rows = []
    for item in found.top or []:
        salts = -(-item["count"] * groups // found.n)
        if len(rows) < room:
            rows.append((item["item"], 0))
        elif salts > 1:
            rows.append((item["item"], salts))
    return spark.createDataFrame(rows, "term string, salts int")


def common_uses(weights: DataFrame, broadcast_bytes: int, sparse: bool, size: int) -> int:
    """The least ``total`` of the commonest terms that fit the limit together; found from ``COMMON_USES`` rows at most."""
    own = F.octet_length("term") + ROW_BYTES + (F.size("weights") * POSTING_BYTES if sparse else 8 * size)
    uses = F.least("total", F.lit(COMMON_USES)).alias("uses")
    taken, least = 0, COMMON_USES + 1
    rows = weights.groupBy(uses).agg(F.sum(own).alias("bytes")).collect()
    for row in sorted(rows, key=lambda row: -row.uses):
        taken += row.bytes
        if taken > broadcast_bytes:
            break
        least = row.uses
    return least


def _split_join(
    words: DataFrame, weights: DataFrame, id_col: str, broadcast_bytes: int, sparse: bool, size: int
) -> DataFrame:
    room = broadcast_bytes // 2
    is_common = F.least("total", F.lit(COMMON_USES)) >= F.lit(common_uses(weights, room, sparse, size))
    common, rare = weights.where(is_common), weights.where(~is_common)
    known = bloom_filter(rare.select(F.col("term").alias("word")))
    rare_words = materialize(
        words.where(F.col("term").isNotNull() & known.may_contain(F.col("term"))), "rare-words"
    )
    # A heavy word may be one that every class has seen.
    widest = ROW_BYTES + size * (POSTING_BYTES if sparse else 8)
    heavy = heavy_words(rare_words, widest, room)
    near_terms = heavy.where("salts = 0").select("term")
    near_weights = common.unionByName(rare.join(F.broadcast(near_terms), "term").select(*weights.columns))
    near = words.join(F.broadcast(near_weights), "term", "left").drop("_position")
    far = _salted_join(rare_words, rare, heavy, id_col)
    return near.unionByName(far.select(*near.columns))


def far_rows(words: DataFrame, weights: DataFrame, heavy: DataFrame, id_col: str) -> DataFrame:
    """Known words that are not broadcast, with their weights: one shuffle by word and salt."""
    known = bloom_filter(weights.select(F.col("term").alias("word")))
    asked = words.where(F.col("term").isNotNull() & known.may_contain(F.col("term")))
    return _salted_join(asked, weights, heavy, id_col)


def _salted_join(words: DataFrame, weights: DataFrame, heavy: DataFrame, id_col: str) -> DataFrame:
    salts = F.coalesce("salts", F.lit(1))
    salted_words = (
        words.join(F.broadcast(heavy), "term", "left")
        .where(salts > 0)
        .withColumn("_first", F.lit(False))
        .withColumn("_salt", F.pmod(F.xxhash64(id_col, "_words_a", "_position"), salts).cast("int"))
        .drop("salts")
    )
    salted_weights = (
        weights.join(F.broadcast(heavy), "term", "left")
        .where(salts > 0)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("salts")
    )
    return salted_words.join(salted_weights, ["term", "_salt"]).drop("_salt")


def _scores(model: BayesModel) -> Column:
    size = len(model.classes)
    priors = F.lit([model.prior(i) for i in range(size)])
    bases = F.lit([model.base(i) for i in range(size)])
    return F.transform(
        "_sums",
        lambda total, i: F.get(priors, i)
        + F.col("_length") * F.get(bases, i)
        + total / F.col("_copies"),
    )

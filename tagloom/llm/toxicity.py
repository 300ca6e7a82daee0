"""Toxicity by a factorization machine over hashed terms.

Score of a document with distinct hashed terms x: sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j> / n).
The pairwise part learns combinations, such as an insult with the mention of a group, which the
weights of single terms miss. It is divided by the number of known terms, so that long texts are not
carried off by pairs of common words.

The machine is fitted in numpy to a bounded sample of labelled rows (``SAMPLE_ROWS`` of each
label, the first by a hash of the id); every text is scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import tables, texts

SAMPLE_ROWS = 2_000
BUCKET_BITS = 20
# Terms are whole words and their beginnings of so many bytes, which inflected forms share.
PREFIX_BYTES = (4, 5, 6)
# Terms in fewer sampled rows, or with a smaller log-likelihood ratio against the label that take part
# in no telling pair either, would be learnt by heart; they keep the weight 0.
LEAST_ROWS = 5
LEAST_RATIO = 15.0
# Pairs of terms in at least so many toxic rows, whose label each term leaves open but both together
# tell. The limit is above what the best of some 10**8 chance pairs reaches.
PAIR_ROWS = 20
LEAST_CHI_SQUARED = 50.0
PAIR_BLOCK = 1024
FACTORS = 4
EPOCHS = 40
BATCH_ROWS = 64
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.7
FOLDS, HELD_OUT_FOLD = 3, 1


@dataclass(frozen=True)
class Machine:
    """``places`` names the row of a bucket's weight and factors; row 0, all zeros, is that of the others."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    places: np.ndarray

    def scores(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities of rows whose terms are ``terms[first[i]:first[i + 1]]``."""
        linear, pairs, _ = self._parts(self.places[terms], first)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs, -500, 500)))

    def _parts(self, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        n = np.maximum(_row_sums(at > 0, first), 1)
        linear = _row_sums(self.weights[at], first)
        v = self.factors[at]
        sums = np.stack([_row_sums(v[:, k], first) for k in range(v.shape[1])], axis=1)
        squares = _row_sums((v * v).sum(axis=1), first)
        return linear, ((sums * sums).sum(axis=1) - squares) / (2 * n), sums


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    # Added up row by row, so that a text scores alike in whatever batch it stands.
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(rows, values, len(first) - 1)


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each row's terms: words of letters and digits, and their beginnings."""
    words = texts.split_words(column, texts.NOT_ALPHANUMERIC, lower=True)
    shift = np.uint64(64 - BUCKET_BITS)
    row = words.rows << BUCKET_BITS
    terms = [row | (words.hashes() >> shift).astype(np.int64)]
    for length in PREFIX_BYTES:
        long = words.ends - words.starts >= length
        ends = words.starts[long] + length
        begin = texts.Words(words.data, words.starts[long], ends, words.first)
        hashed = texts.mix(begin.hashes(), length) >> shift
        terms.append(row[long] | hashed.astype(np.int64))
    distinct = np.unique(np.concatenate(terms))
    first = np.searchsorted(distinct, np.arange(len(column) + 1) << BUCKET_BITS)
    return distinct & ((1 << BUCKET_BITS) - 1), first


def telling(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which buckets occur often enough and not alike under both labels, alone or in pairs."""
    n, toxic = len(rows), labels.sum()
    a = _counts([rows[i] for i in np.flatnonzero(labels == 1)])
    total = a + _counts([rows[i] for i in np.flatnonzero(labels != 1)])
    out = in_pairs(rows, labels, a)
    some = np.flatnonzero(total >= LEAST_ROWS)
    a, total = a[some], total[some]
    ratio = np.zeros(len(some))
    for seen, label_share in ((a, toxic / n), (total - a, 1 - toxic / n)):
        for observed, expected in (
            (seen, total * label_share), (n * label_share - seen, (n - total) * label_share)
        ):
            ratio += 2 * observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9))
    out[some[ratio >= LEAST_RATIO]] = True
    return out


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of every bucket, added up by a few rows at a time."""
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for start in range(0, len(rows), 256):
        np.add.at(out, np.concatenate(rows[start : start + 256]), 1)
    return out


def in_pairs(rows: list[np.ndarray], labels: np.ndarray, toxic_rows: np.ndarray) -> np.ndarray:
    """Which buckets tell the label together with another one.

    Among the rows with either term the other one has to go with the label, so that a telling term
    does not pull in every common one that stands beside it.
    """
    terms = np.flatnonzero(toxic_rows >= PAIR_ROWS)
    place = np.full(len(toxic_rows), -1)
    place[terms] = np.arange(len(terms))
    toxic, clean = (np.zeros(((labels == k).sum(), len(terms)), np.uint8) for k in (1, 0))
    for held, label in ((toxic, 1), (clean, 0)):
        for i, row in enumerate(np.flatnonzero(labels == label)):
            at = place[rows[row]]
            held[i, at[at >= 0]] = 1
    t = toxic.sum(axis=0, dtype=np.int64)
    n = t + clean.sum(axis=0, dtype=np.int64)
    share = t / np.maximum(n, 1)
    telling = np.zeros(len(terms), bool)
    starts = range(0, len(terms), PAIR_BLOCK)
    for start, other in ((x, y) for x in starts for y in starts if x <= y):
        cut, rest = slice(start, start + PAIR_BLOCK), slice(other, other + PAIR_BLOCK)
        hits, misses = (x[:, cut].T.astype(np.float32) @ x[:, rest].astype(np.float32) for x in (toxic, clean))
        both = hits + misses
        more = hits - both * np.maximum(share[cut, None], share[None, rest])
        i, j = np.nonzero((hits >= PAIR_ROWS) & (more > 0))
        hits, both, i, j = hits[i, j], both[i, j], i + start, j + other
        least = np.full(len(hits), np.inf)
        for one in (i, j):
            expected = both * share[one]
            spread = np.maximum(expected * (1 - share[one]) * (1 - both / n[one]), 1e-3)
            least = np.minimum(least, (hits - expected) ** 2 / spread)
        found = least >= LEAST_CHI_SQUARED
        telling[i[found]] = telling[j[found]] = True
    out = np.zeros(len(toxic_rows), bool)
    out[terms[telling]] = True
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over mini-batches; without both labels a constant."""
    random = np.random.default_rng(seed)
    places = np.zeros(1 << BUCKET_BITS, np.int32)
    if not len(rows) or labels.min() == labels.max():
        known = float(labels.mean()) if len(rows) else 0.0
        bias = -500.0 if known == 0 else 500.0
        return Machine(bias, np.zeros(1), np.zeros((1, FACTORS)), places)
    bias, seen_b = 0.0, 1e-8
    held = np.flatnonzero(telling(rows, labels))
    # Only the buckets that take part have rows, however many there are.
    places[held] = np.arange(1, len(held) + 1)
    rows = [places[terms[places[terms] > 0]] for terms in rows]
    size = len(held) + 1
    weights, factors = np.zeros(size), np.zeros((size, FACTORS))
    # A start for each bucket there could be, drawn a part at a time.
    for low in range(0, len(places), 1 << 16):
        part = held[np.searchsorted(held, low) : np.searchsorted(held, low + (1 << 16))]
        factors[places[part]] = random.normal(0, 0.01, (1 << 16, FACTORS))[part - low]
    seen_w, seen_v = np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), BATCH_ROWS):
            chosen = order[start : start + BATCH_ROWS]
            first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in chosen])])
            terms = np.concatenate([rows[i] for i in chosen])
            machine = Machine(bias, weights, factors, places)
            linear, pairs, sums = machine._parts(terms, first)
            p = 1 / (1 + np.exp(-np.clip(bias + linear + pairs, -50, 50)))
            slope = (p - labels[chosen]) / len(chosen)
            row = np.repeat(np.arange(len(chosen)), np.diff(first))
            used, at = np.unique(terms, return_inverse=True)
            per_term = slope[row]
            g = np.bincount(at, per_term) + DECAY * weights[used]
            seen_w[used] += g * g
            weights[used] -= RATE * g / np.sqrt(seen_w[used])
            scaled = per_term / np.maximum(np.diff(first), 1)[row]
            v = factors[terms]
            for k in range(FACTORS):
                h = np.bincount(at, scaled * (sums[row, k] - v[:, k])) + DECAY * factors[used, k]
                seen_v[used, k] += h * h
                factors[used, k] -= RATE * 0.3 * h / np.sqrt(seen_v[used, k])
            seen_b += slope.sum() ** 2
            bias -= RATE * slope.sum() / np.sqrt(seen_b)
    return Machine(bias, weights, factors, places)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit to at most ``SAMPLE_ROWS`` labelled training rows of each label."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & tables.in_training("doc_id", FOLDS, HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(F.col("doc_id").isNotNull())
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where(F.col("toxic") == 1).orderBy(*order).limit(SAMPLE_ROWS).union(
        known.where(F.col("toxic") == 0).orderBy(*order).limit(SAMPLE_ROWS)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches):
            flat, first = hashed_terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("toxic").cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32())),
                ],
                names=["doc_id", "toxic", "terms"],
            )

    # Repeated rows of a document count once.
    schema = "doc_id long, toxic long, terms array<int>"
    sample = rows.mapInArrow(terms, schema).dropDuplicates(["doc_id"])
    # A bounded sample: one task learns from it, and the driver holds no more than the machine.
    learnt = sample.repartition(1).mapInArrow(
        _learn, "bias double, held array<int>, weights array<double>, factors array<double>"
    ).toArrow()
    if not learnt.num_rows:
        return fit([], np.zeros(0))
    held, weights, factors = (learnt.column(c)[0].values.to_numpy() for c in ("held", "weights", "factors"))
    places = np.zeros(1 << BUCKET_BITS, np.int32)
    places[held] = np.arange(1, len(held) + 1)
    return Machine(learnt.column("bias")[0].as_py(), weights, factors.reshape(-1, FACTORS), places)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine fitted to all rows, in one row; its held buckets are in the order of their places."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        sample = pa.Table.from_batches(held).sort_by("doc_id")
        held.clear()
        features = [x.values.to_numpy() for x in sample.column("terms")]
        machine = fit(features, sample.column("toxic").to_numpy().astype(float))
        held = np.flatnonzero(machine.places).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([machine.bias]), *(pa.array([x]) for x in (held, machine.weights, machine.factors.ravel()))],
            names=["bias", "held", "weights", "factors"],
        )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all columns, without the rows that score the threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches):
            scores = shared.value.scores(*hashed_terms(batch.column("text")))
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``.

    A null or empty text has no terms and gets the score of the bias. A null doc_id is scored
    and not held out. Repeated rows get equal scores. Without labels scores are
    below 1e-9. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches):
            scores = shared.value.scores(*hashed_terms(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(scores)], names=["doc_id", "score"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (~tables.in_training("doc_id", FOLDS, HELD_OUT_FOLD)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

"""Scores of texts by a log-bilinear language model, trained with noise-contrastive estimation.

The two words before predict the next one: score(w) = (c1 * r_prev + c2 * r_prev2) . q_w + b_w. The
frequent words (``HOT_SHARE``) have vectors of their own, before and after; all others share one more
symbol and are told apart by their counts. The ``HEAD`` most frequent words, the shared symbol and classes
of words of like frequency are predicted first, then the word within its class, each step normalised
over its choices, so the model is normalised over all texts. Counts of all words
come from all training texts. So do the parameters: each partition follows noise-contrastive
gradients over its own tokens in numpy, from one start, and Spark averages the results by tokens.

Frequent words meet a table of bounded size on the map side; only rare words are shuffled to
their counts, one row per document and word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import superkmers, tables, texts
from tagloom.shared import materialize

HEAD = 255
# Words of a class: so many, or the root of the number of words.
CLASS_WORDS = 256
WIDTH = 16
NOISE = 16
CLASS_NOISE = 4
BATCH_TOKENS = 4096
# Contexts that are normalised at once: their scores of all choices stay in a core's cache.
SCORED_ROWS = 256
# Words of a chunk whose exponentials of all first choices are kept while its contexts are normalised.
TABLED_WORDS = 1 << 13
RATE = 0.05
# Every trainer sends all parameters, so partitions are joined up to about so many tokens each.
TRAINER_TOKENS = 1 << 21
# Parameters of a row that a trainer sends.
BLOCK = 1 << 10
FOLDS, HELD_OUT_FOLD = 7, 2
# A word with one in so many tokens is frequent: no more than HOT_SHARE words are.
HOT_SHARE = 1 << 19
# Text that is scored at once: the more, the more contexts occur again.
CHUNK_BYTES = 1 << 21
# Tokens whose counts are combined before they leave a task.
COMBINED_TOKENS = 1 << 22

END = np.uint64(1)


@dataclass(frozen=True)
class Words:
    """Frequent words in order with their counts and symbols, and totals of the training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    size: int
    tokens: int
    distinct: int
    other_tokens: int
    other_distinct: int

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(count, symbol)`` of words; count 0 for what is not frequent."""
        if not len(self.hashes):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        known = self.hashes[at] == words
        return np.where(known, self.counts[at], 0), np.where(known, self.symbols[at], self.size)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, each text's end included, and the bounds of its rows."""
    words = texts.split_words(column, lower=True)
    hashes = np.insert(words.hashes(), words.first[1:], END)
    return hashes, words.first + np.arange(len(words.first))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, held = [], 0

    def combined() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(kept), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in texts.chunks(batches, limit=CHUNK_BYTES):
        hashes, _ = tokens_of(batch.column("text"))
        kept.append(hashes)
        held += len(hashes)
        if held >= COMBINED_TOKENS:
            yield combined()
            kept, held = [], 0
    if kept:
        yield combined()


def frequent_words(counts: DataFrame) -> Words:
    """The frequent words of ``counts(word, c)``; bounded by HOT_SHARE."""
    total = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")
    ).first()
    hot = counts.where(F.col("c") >= max(2, total.tokens // HOT_SHARE)).toArrow()
    word, c = hot.column("word").to_numpy().view(np.uint64), hot.column("c").to_numpy()
    order = np.argsort(word)
    word, c = word[order], c[order]
    chosen = np.lexsort((word, -c))
    symbols = np.full(len(word), len(chosen))
    symbols[chosen] = np.arange(len(chosen))
    return Words(
        word, c, symbols, len(chosen), total.tokens, total.distinct,
        total.tokens - int(c[chosen].sum()), total.distinct - len(chosen),
    )


@dataclass
class Model:
    """Parameters in one vector: words before, choices to come, biases, and both position scales.

    Choices are the words, the shared symbol, and the classes of the words behind ``HEAD``.
    """

    size: int
    flat: np.ndarray

    @property
    def class_words(self) -> int:
        return max(CLASS_WORDS, int(np.ceil(np.sqrt(self.size))))

    @property
    def classes(self) -> int:
        return -(-max(0, self.size - HEAD) // self.class_words)

    @property
    def choices(self) -> int:
        return self.size + 1 + self.classes

    def firsts(self) -> np.ndarray:
        """Choices of the first step."""
        return np.concatenate([np.arange(min(HEAD, self.size)), np.arange(self.size, self.choices)])

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.parts_of(self.flat)

    def parts_of(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        before, after, n = (self.size + 2) * WIDTH, self.choices * WIDTH, self.choices
        cuts = np.split(flat, np.cumsum([before, after, n, WIDTH]))
        return cuts[0].reshape(-1, WIDTH), cuts[1].reshape(-1, WIDTH), cuts[2], cuts[3], cuts[4]

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        """Class of every symbol, -1 for those that are chosen in the first step."""
        behind = (symbols >= HEAD) & (symbols < self.size)
        return np.where(behind, (symbols - HEAD) // self.class_words, -1)

    def members(self, k: int | np.ndarray) -> tuple[int | np.ndarray, int | np.ndarray]:
        """First word and end of a class."""
        low = HEAD + k * self.class_words
        return low, np.minimum(low + self.class_words, self.size)

    def mixed(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all words as the first and as the second word before."""
        before, _, _, first_scale, second_scale = self.parts()
        return before * first_scale, before * second_scale

    def log_totals(self, contexts: np.ndarray) -> np.ndarray:
        """Log of the first step's normalising sums of contexts ``previous * (size + 2) + second``."""
        _, after, bias, _, _ = self.parts()
        firsts, (near, far) = self.firsts(), self.mixed()
        choices = _Choices(after[firsts], bias[firsts])
        one, two = np.divmod(contexts, self.size + 2)
        out = np.empty(len(contexts))
        # The exponentials of a word that stands in many contexts are taken once.
        times = np.bincount(two, minlength=self.size + 2)
        tabled = np.argsort(-times, kind="stable")[:TABLED_WORDS]
        tabled = tabled[times[tabled] > 1]
        slot = np.full(self.size + 2, -1)
        if choices.bound(near.take(one, axis=0)) < 30 and choices.bound(far.take(two, axis=0)) < 30:
            slot[tabled] = np.arange(len(tabled))
            table = choices.exponentials(far[tabled])
        slot = slot[two]
        with_slot, rest = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        with_slot = with_slot[np.argsort(one[with_slot], kind="stable")]
        for start in range(0, len(with_slot), SCORED_ROWS):
            rows = with_slot[start : start + SCORED_ROWS]
            word = one[rows]
            new = np.concatenate([[True], word[1:] != word[:-1]])
            firsts_of = choices.exponentials(near[word[new]], biased=False).take(np.cumsum(new) - 1, axis=0)
            out[rows] = np.log(np.vecdot(firsts_of, table.take(slot[rows], axis=0)))
        for start in range(0, len(rest), SCORED_ROWS):
            rows = rest[start : start + SCORED_ROWS]
            out[rows] = choices.log_sums(near.take(one[rows], axis=0) + far.take(two[rows], axis=0))
        return out

    def log_shares(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log-probabilities of targets behind their contexts."""
        _, after, bias, _, _ = self.parts()
        near, far = self.mixed()
        context, place = np.unique(one * (self.size + 2) + two, return_inverse=True)
        own, k = -self.log_totals(context)[place], self.class_of(target)
        first = np.where(k < 0, target, self.size + 1 + k)
        # A class is normalised once behind a context.
        behind = np.flatnonzero(k >= 0)
        pair, at_pair = np.unique(k[behind] * len(context) + place[behind], return_inverse=True)
        group_of, of = np.divmod(pair, max(1, len(context)))
        before_one, before_two = np.divmod(context[of], self.size + 2)
        totals = np.empty(len(pair))
        bounds = np.searchsorted(group_of, np.arange(self.classes + 1))
        for at in range(0, len(target), 1 << 16):
            cut = slice(at, at + (1 << 16))
            q = near.take(one[cut], axis=0) + far.take(two[cut], axis=0)
            own[cut] += _dots(q, after.take(first[cut], axis=0)) + bias[first[cut]]
            within = behind[slice(*np.searchsorted(behind, [at, at + (1 << 16)]))]
            own[within] += _dots(q.take(within - at, axis=0), after.take(target[within], axis=0))
        for group in np.flatnonzero(np.diff(bounds)).tolist():
            low, end = self.members(group)
            choices = _Choices(after[low:end], bias[low:end])
            for at in range(bounds[group], bounds[group + 1], SCORED_ROWS):
                cut = slice(at, min(at + SCORED_ROWS, bounds[group + 1]))
                totals[cut] = choices.log_sums(
                    near.take(before_one[cut], axis=0) + far.take(before_two[cut], axis=0)
                )
        own[behind] += bias[target[behind]] - totals[at_pair]
        return own


class _Choices:
    """Choices of one step, their biases as one more component behind their vectors."""

    def __init__(self, vectors: np.ndarray, bias: np.ndarray) -> None:
        self.both = np.concatenate([vectors, bias[:, None]], axis=1).T.copy()
        self.longest = float(np.sqrt(_dots(vectors, vectors).max(initial=0)))
        self.highest = float(np.abs(bias).max(initial=0))

    def bound(self, q: np.ndarray) -> float:
        """No score of a row of ``q`` is further from 0."""
        return self.longest * float(np.sqrt(_dots(q, q).max(initial=0))) + self.highest

    def scores(self, q: np.ndarray, biased: bool = True) -> np.ndarray:
        if not biased:
            return q @ self.both[:-1]
        return np.concatenate([q, np.ones((len(q), 1), q.dtype)], axis=1) @ self.both

    def exponentials(self, q: np.ndarray, biased: bool = True) -> np.ndarray:
        scores = self.scores(q, biased)
        return np.exp(scores, out=scores)

    def log_sums(self, q: np.ndarray) -> np.ndarray:
        """Log of the summed exponentials of the scores of all choices, for every row of ``q``."""
        if self.bound(q) < 60:
            # Nothing overflows and no sum is lost: the usual case needs no shift.
            return np.log(_row_sums(self.exponentials(q)))
        scores = self.scores(q)
        top = scores.max(axis=1)
        scores -= top[:, None]
        np.exp(scores, out=scores)
        return top + np.log(_row_sums(scores))


def _row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], values.dtype)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of vectors of equal place."""
    return np.einsum("...j,...j->...", a, b)


def noise_of(words: Words) -> np.ndarray:
    """Share of every symbol among the training tokens, no share being zero."""
    counts = np.bincount(words.symbols, words.counts, words.size + 1)
    counts[words.size] = words.other_tokens
    return (counts + 1) / (counts + 1).sum()


def start(words: Words) -> Model:
    random = np.random.default_rng(5)
    model = Model(words.size, np.zeros(0))
    noise = noise_of(words)
    k = model.class_of(np.arange(words.size + 1))
    shares = np.bincount(k[k >= 0], noise[k >= 0], model.classes)
    bias = np.log(np.concatenate([noise, shares]))
    bias[: len(k)][k >= 0] -= np.log(shares[k[k >= 0]])
    vectors = random.normal(0, 0.1, (words.size + 2 + model.choices) * WIDTH)
    model.flat = np.concatenate([vectors, bias, np.ones(2 * WIDTH)]).astype(np.float32)
    return model


def contexts_of(symbols: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols one and two places before, the start symbol in front of a text."""
    place = np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))
    one = np.where(place >= 1, np.roll(symbols, 1), size + 1)
    two = np.where(place >= 2, np.roll(symbols, 2), size + 1)
    return one, two


class Trainer:
    """Noise-contrastive AdaGrad steps; every batch shares the noise of its first choices."""

    def __init__(self, words: Words, seed: int) -> None:
        self.model = start(words)
        self.firsts = self.model.firsts()
        noise = np.exp(self.model.parts()[2][self.firsts].astype(np.float64))
        self.noise = noise / noise.sum()
        self.log_noise = np.zeros(self.model.choices, np.float32)
        self.log_noise[self.firsts] = np.log(NOISE * self.noise)
        self.seen = np.ones(len(self.model.flat), np.float32)
        self.random = np.random.default_rng(seed)
        self.tokens = 0

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        model = self.model
        before, after, bias, scale_one, scale_two = model.parts()
        near, far = before.take(one, axis=0), before.take(two, axis=0)
        q = near * scale_one + far * scale_two
        k = model.class_of(target)
        first = np.where(k < 0, target, model.size + 1 + k)
        noise = self.firsts[self.random.choice(len(self.firsts), NOISE, p=self.noise)]
        vectors, shared = after.take(first, axis=0), after.take(noise, axis=0)
        up = _up(_dots(q, vectors) + bias[first] - self.log_noise[first])
        down = -_up(-(q @ shared.T + bias[noise] - self.log_noise[noise]))
        g_q = up[:, None] * vectors
        g_q += down @ shared
        # A choice's slope is a multiple of the context of a place; the shared noise has sums of contexts.
        contexts, place = np.concatenate([q, down.T @ q]), [np.arange(len(q) + NOISE)]
        rows, slopes, slopes_b = [first, noise], [up, np.ones(NOISE, up.dtype)], [up, down.sum(axis=0)]
        behind = np.flatnonzero(k >= 0)
        if len(behind):
            low, end = model.members(k[behind])
            other = low + (self.random.random((CLASS_NOISE, len(behind))) * (end - low)).astype(np.int64)
            level = np.log(CLASS_NOISE / (end - low)).astype(np.float32)
            words = np.concatenate([target[behind][None], other])
            vectors = after.take(words, axis=0)
            score = _dots(vectors, q.take(behind, axis=0)) + bias[words] - level
            score[1:] *= -1
            slope = _up(score)
            slope[1:] *= -1
            vectors *= slope[:, :, None]
            g_q[behind] += vectors.sum(axis=0)
            rows.append(words.ravel())
            place.append(np.tile(behind, len(words)))
            slopes.append(slope.ravel())
            slopes_b.append(slope.ravel())
        seen = model.parts_of(self.seen)
        g_one, g_two = np.einsum("ij,ij->j", g_q, near), np.einsum("ij,ij->j", g_q, far)
        used, order, begin = _grouped(np.concatenate([one, two]))
        g_both = np.concatenate([g_q * scale_one, g_q * scale_two])
        _climb(before, seen[0], used, _summed(g_both.take(order, axis=0), begin))
        used, order, begin = _grouped(np.concatenate(rows))
        g_after = contexts.take(np.concatenate(place)[order], axis=0)
        g_after *= np.concatenate(slopes)[order][:, None]
        _climb(after, seen[1], used, _summed(g_after, begin))
        _climb(bias, seen[2], used, np.add.reduceat(np.concatenate(slopes_b)[order], begin))
        every = np.arange(WIDTH)
        _climb(scale_one, seen[3], every, g_one)
        _climb(scale_two, seen[4], every, g_two)
        self.tokens += len(target)


def _up(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(score, -30, 30)))


def _climb(values: np.ndarray, seen: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    so_far = seen.take(rows, axis=0)
    so_far += g * g
    _put(seen, rows, so_far)
    step = g / np.sqrt(so_far, out=so_far)
    step *= RATE
    step += values.take(rows, axis=0)
    _put(values, rows, step)


def _put(values: np.ndarray, rows: np.ndarray, new: np.ndarray) -> None:
    """``values[rows] = new``, a whole row as one item."""
    if values.ndim == 2:
        item = f"V{values.shape[1] * values.itemsize}"
        values, new = values.view(item)[:, 0], new.view(item)[:, 0]
    values[rows] = new


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, the stable order of all, and where each one's group begins in it."""
    bits = len(rows).bit_length()
    # Sorting row and place in one number is faster than sorting places by rows.
    both = np.sort(rows << bits | np.arange(len(rows)))
    ordered, order = both >> bits, both & ((1 << bits) - 1)
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[begin], order, begin


# Most groups are small: so many of their rows are added one by one.
FEW = 4


def _summed(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the groups of rows that begin there."""
    out, size = values.take(begin, axis=0), np.diff(begin, append=len(values))
    more = np.flatnonzero(size > 1)
    for j in range(1, FEW):
        out[more] += values.take(begin[more] + j, axis=0)
        more = more[size[more] > j + 1]
    if len(more):
        # The rest of each large group, up to the next large group's rest.
        bounds = np.stack([begin[more] + FEW, begin[more] + size[more]], axis=1).ravel()
        bounds = bounds[:-1] if bounds[-1] == len(values) else bounds
        out[more] += np.add.reduceat(values, bounds, axis=0)[::2]
    return out


def train(docs: DataFrame, words: Words) -> Model:
    """Averages, by tokens, of what the partitions of ``docs`` have learnt."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for batch in texts.chunks(batches, limit=CHUNK_BYTES):
            trainer = trainer or Trainer(shared.value, 9)
            hashes, first = tokens_of(batch.column("text"))
            symbols = shared.value.look_up(hashes)[1]
            one, two = contexts_of(symbols, first, shared.value.size)
            for at in range(0, len(symbols), BATCH_TOKENS):
                cut = slice(at, at + BATCH_TOKENS)
                trainer.step(symbols[cut], one[cut], two[cut])
        if trainer is not None:
            flat = trainer.model.flat
            bounds = np.append(np.arange(0, len(flat), BLOCK), len(flat))
            blocks = len(bounds) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(blocks), pa.int32()),
                    pa.array(np.full(blocks, trainer.tokens), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)),
                ],
                names=["block", "tokens", "value"],
            )

    trainers = max(1, -(-words.tokens // TRAINER_TOKENS))
    learnt = docs.select("text").coalesce(trainers).mapInArrow(learn, "block int, tokens long, value array<float>")
    blocks = tables.sorted_by(learnt, ["block"], ["tokens"])
    table = blocks.mapInArrow(_averages, "block int, value array<float>").toArrow()
    model = start(words)
    for block, value in zip(table.column("block").to_pylist(), table.column("value"), strict=True):
        at = block * BLOCK
        model.flat[at : at + BLOCK] = value.values.to_numpy()
    return model


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block's average by tokens over what the trainers have learnt."""
    for table, bounds in tables.whole_groups(batches, ["block"], 256):
        tokens = table.column("tokens").to_numpy()
        learnt = table.column("value").combine_chunks()
        blocks, values = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            flat = learnt.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
            blocks.append(table.column("block")[a].as_py())
            values.append((tokens[a:b] @ flat.astype(np.float64) / tokens[a:b].sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array(values, pa.list_(pa.float32()))], names=["block", "value"]
        )


def scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Takes ``docs(doc_id, text)``. A null or empty text is its end token only. A null doc_id
    counts as a training row. Repeated rows are learnt from as often as they occur and get equal scores.
    Without training rows every known count is 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    keyed = superkmers.with_keys(docs)
    learning = keyed.where(tables.in_training("doc_id", FOLDS, HELD_OUT_FOLD))
    counts = materialize(
        learning.select("text").mapInArrow(_counts, "word long, n long")
        .groupBy("word").agg(F.sum("n").alias("c")),
        "word-counts",
    )
    words = frequent_words(counts)
    model = train(learning, words)
    shared = spark.sparkContext.broadcast((words, Model(model.size, model.flat.astype(np.float32))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        size = words.size
        for batch in texts.chunks(batches, limit=CHUNK_BYTES):
            hashes, first = tokens_of(batch.column("text"))
            c, symbols = words.look_up(hashes)
            one, two = contexts_of(symbols, first, size)
            own = model.log_shares(symbols, one, two) / np.log(10)
            other = symbols == size
            own[other] -= np.log10(words.other_tokens + words.other_distinct + 1)
            known = np.log10(c + 1.0)
            own[other] += known[other]
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            rare = np.flatnonzero(c == 0)
            order = np.lexsort((hashes[rare], row[rare]))
            word, at = hashes[rare][order], row[rare][order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1])
            begin = np.flatnonzero(new)
            n = np.diff(np.concatenate([begin, [len(word)]]))
            bounds = np.searchsorted(at[begin], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(x) for x in ("doc_id", "k1", "k2")],
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(np.bincount(row, c > 0, batch.num_rows).astype(np.int64)),
                    pa.array(np.bincount(row, known, batch.num_rows)),
                    pa.array(np.bincount(row, own, batch.num_rows)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(word[begin].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(n, pa.int32())),
                ],
                names=["doc_id", "k1", "k2", "n_tokens", "n_hot", "known", "own", "rare", "times"],
            )

    schema = (
        "doc_id long, k1 long, k2 long, n_tokens long, n_hot long, known double, own double, "
        "rare array<long>, times array<int>"
    )
    scored = materialize(keyed.mapInArrow(score, schema), "scored")
    copies = scored.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))
    exploded = scored.select("k1", "k2", F.inline(F.arrays_zip("rare", "times")).alias("word", "times"))
    met = exploded.join(counts, "word")
    # Equal rows add up the same words once more each.
    rare = met.groupBy("k1", "k2").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_known")
    )
    both = scored.drop("rare", "times").join(copies, ["k1", "k2"]).join(rare, ["k1", "k2"], "left")
    rest = F.coalesce(F.col("rare_known") / F.col("copies"), F.lit(0.0))
    base = float(np.log10(words.tokens + words.distinct + 1))
    return both.select(
        "doc_id",
        (~tables.in_training("doc_id", FOLDS, HELD_OUT_FOLD)).alias("held_out"),
        "n_tokens",
        (F.col("n_hot") + F.coalesce(F.col("n_rare") / F.col("copies"), F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("known") + rest - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("own") + rest).alias("score"),
    )

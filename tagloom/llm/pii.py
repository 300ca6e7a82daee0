"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs without white space. The field labels each token as outside or as part of an
e-mail address, IP address, card or phone number from features of word shapes: of the token, of
its neighbours, and the transition of labels. It is trained in numpy on a small labelled
table: tokens of a bounded sample of documents (``SAMPLE_ROWS``), labelled by the patterns. Only
tokens with a digit, ``@`` or ``+`` may carry a label; runs of them are decoded by Viterbi, all runs of
a batch at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 800
# The sample is sorted out of about so many times its rows.
CUT = 8
ROUNDS = 150
RATE = 0.3
DECAY = 1e-3

LOCAL_PART = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The look-behind spares the starts inside a run of digits, which end as the run's first does.
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
TRIMMED = b".,;:!?()[]{}<>\"'*&#$%"

MARKED = np.zeros(256, bool)
MARKED[48:58] = MARKED[[43, 64]] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for place, byte in enumerate(reversed(digits)):
        value = (byte - 48) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def digits_of(text: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", text)


def emails(text: bytes) -> list[tuple[int, int]]:
    spans, last = [], 0
    for match in DOMAIN.finditer(text):
        start = match.start()
        while start > last and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < match.start():
            spans.append((start, match.end()))
            last = match.end()
    return spans


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in bytes of every pattern match that holds, by kind and start."""
    found = [(0, *span) for span in emails(text)] if b"@" in text else []
    if text.count(b".") >= 3:
        for match in IP.finditer(text):
            parts = [part.lstrip(b"0") or b"0" for part in match[0].split(b".")]
            if all(len(part) <= 3 and int(part) <= 255 for part in parts):
                found.append((1, *match.span()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 13:
            digits = digits_of(match[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *match.span()))
    if b"+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(digits_of(match[0])) <= 15:
                found.append((3, *match.span()))
    return found


# --- features ----------------------------------------------------------------------------

LEVELS = 10
ATTRIBUTES = 9


def shape(token: bytes) -> tuple[int, ...]:
    """Attributes of a token's shape, each below ``LEVELS``."""
    core = token.strip(TRIMMED)
    digits = digits_of(core)
    n = len(digits)
    letters = sum(core.count(bytes([c])) for c in set(core) if chr(c).isalpha() or c > 127)
    at = core.find(b"@")
    mail = 0 if at < 0 else 1 + (at > 0) + 2 * (b"." in core[at:].strip(b"."))
    dots = core.split(b".")
    quad = len(dots) == 4 and all(d.isdigit() and len(d) <= 3 for d in dots)
    return (
        int(np.searchsorted([1, 2, 3, 4, 5, 8, 13, 20], n, side="right")),
        min(letters, 3),
        mail,
        min(core.count(b"."), 4),
        (2 if core[:1] == b"+" else 1) if b"+" in token else 0,
        1 if 13 <= n <= 19 and luhn(digits) else 0,
        2 if quad and all(int(d) <= 255 for d in dots) else int(quad),
        min(core.count(b"-"), 2) + 3 * (token[:1] == b"("),
        int(len(core) == n) + 2 * (core[:1].isdigit()) + 4 * (token[-1:] in (b",", b".")),
    )


BLANK = (0,) * ATTRIBUTES
FEATURES = 3 * ATTRIBUTES * LEVELS


def token_features(shapes: list[tuple[int, ...]], run: np.ndarray) -> np.ndarray:
    """``(token, 3 * ATTRIBUTES)`` feature numbers: own shape, the one before, the one after."""
    own = np.array(shapes, np.int64).reshape(-1, ATTRIBUTES)
    blank = np.full(ATTRIBUTES, LEVELS - 1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    first = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    last = np.concatenate([run[1:] != run[:-1], [True]]) if len(run) else np.zeros(0, bool)
    before[first], after[last] = blank, blank
    return np.concatenate([own, before, after], axis=1) + np.arange(3 * ATTRIBUTES) * LEVELS


@dataclass(frozen=True)
class Field:
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)

    def decode(self, features: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Viterbi labels of all runs at once; ``run`` numbers the runs in order."""
        scores = self.emissions(features)
        first, length = _runs(run)
        n = scores.shape[1]
        back = np.zeros((len(scores), n), np.int64)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        best = scores[first]
        final = np.zeros((len(first), n))
        for step in range(1, int(length.max(initial=0)) + 1):
            active = int(np.searchsorted(-length, -step, side="right"))
            going = int(np.searchsorted(-length, -(step + 1), side="right"))
            final[going:active] = best[going:active]
            if not going:
                break
            paths = best[:going, :, None] + self.transitions
            at = first[:going] + step
            back[at] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[at]
        labels = np.zeros(len(scores), np.int64)
        state = final.argmax(axis=1)
        for step in range(int(length.max(initial=0)) - 1, -1, -1):
            active = int(np.searchsorted(-length, -(step + 1), side="right"))
            at = first[:active] + step
            labels[at] = state[:active]
            if step:
                state[:active] = back[at, state[:active]]
        return labels


def _runs(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run[:0]
    return first, np.diff(np.concatenate([first, [len(run)]]))


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train_field(features: np.ndarray, run: np.ndarray, labels: np.ndarray) -> Field:
    """Likelihood of the labelled runs, climbed by AdaGrad on forward-backward gradients."""
    n = len(KINDS) + 1
    weights, transitions = np.zeros((FEATURES, n)), np.zeros((n, n))
    weights[:, 0] = 1e-3
    if not len(run):
        return Field(weights, transitions)
    first, length = _runs(run)
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    known = np.eye(n)[labels]
    pairs = np.zeros((n, n))
    inner = np.flatnonzero(run[1:] == run[:-1]) + 1
    np.add.at(pairs, (labels[inner - 1], labels[inner]), 1)
    for _ in range(ROUNDS):
        scores = weights[features].sum(axis=1)
        ahead, behind = scores.copy(), np.zeros_like(scores)
        for step in range(1, int(length.max())):
            at = first[length > step] + step
            ahead[at] += _sum_exp(ahead[at - 1][:, :, None] + transitions, 1)
        for step in range(int(length.max()) - 1, 0, -1):
            at = first[length > step] + step
            behind[at - 1] = _sum_exp(transitions + (behind[at] + scores[at])[:, None, :], 2)
        log_total = np.repeat(_sum_exp(ahead[first + length - 1], 1), length)
        marginal = np.exp(ahead + behind - log_total[:, None])
        joint = np.exp(
            ahead[inner - 1][:, :, None] + transitions
            + (scores[inner] + behind[inner])[:, None, :] - log_total[inner][:, None, None]
        ).sum(axis=0) if len(inner) else np.zeros((n, n))
        error = (known - marginal) / len(first)
        g = np.stack(
            [np.bincount(features.ravel(), np.repeat(error[:, k], features.shape[1]), FEATURES) for k in range(n)],
            axis=1,
        ) - DECAY * weights
        h = (pairs - joint) / len(first) - DECAY * transitions
        seen_w += g * g
        seen_t += h * h
        weights += RATE * g / np.sqrt(seen_w)
        transitions += RATE * h / np.sqrt(seen_t)
    return Field(weights, transitions)


# --- texts -------------------------------------------------------------------------------


@dataclass
class Tokens:
    """The marked tokens of one text: bounds in bytes, shapes, and the runs they form."""

    starts: np.ndarray
    ends: np.ndarray
    shapes: list[tuple[int, ...]]
    run: np.ndarray


def marked_tokens(words: texts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words with a digit, ``@`` or ``+``, and the run each belongs to."""
    marks = np.flatnonzero(MARKED[words.data])
    chosen = np.unique(np.searchsorted(words.starts, marks, side="right") - 1)
    rows = np.searchsorted(words.first, chosen, side="right")
    new = np.ones(len(chosen), bool)
    new[1:] = (np.diff(chosen) > 1) | (np.diff(rows) > 0)
    return chosen, np.cumsum(new)


def spans_of(column: pa.Array, field: Field | None) -> tuple[list[list], list[list], np.ndarray]:
    """Base spans and added spans ``(kind, start, end)`` of every row, in code points.

    Without a field no spans are added.
    """
    data, offsets = texts.utf8(column)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marks = np.concatenate([[0], np.cumsum(MARKED[data])])
    rows = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
    base: list[list] = [[] for _ in range(len(column))]
    taken: list[list] = [[] for _ in range(len(column))]
    for row in rows.tolist():
        a, b = int(offsets[row]), int(offsets[row + 1])
        taken[row] = base_spans(data[a:b].tobytes())
        base[row] = [(k, *_points(points, a, a + s, a + e)) for k, s, e in taken[row]]
    added: list[list] = [[] for _ in range(len(column))]
    if field is None:
        return base, added, offsets
    words = texts.split_words(column)
    chosen, run = marked_tokens(words)
    if not len(chosen):
        return base, added, offsets
    shapes = [shape(data[words.starts[i] : words.ends[i]].tobytes()) for i in chosen]
    labels = field.decode(token_features(shapes, run), run)
    row_of = np.searchsorted(words.first, chosen, side="right") - 1
    cut = np.ones(len(chosen), bool)
    cut[1:] = (labels[1:] != labels[:-1]) | (run[1:] != run[:-1])
    begins = np.flatnonzero(cut)
    for i, j in zip(begins, [*begins[1:], len(chosen)], strict=True):
        if labels[i]:
            row = int(row_of[i])
            a, s, e = int(offsets[row]), int(words.starts[chosen[i]]), int(words.ends[chosen[j - 1]])
            raw = data[s:e].tobytes()
            e -= len(raw) - len(raw.rstrip(TRIMMED))
            s += len(raw) - len(raw.lstrip(TRIMMED.replace(b"(", b"")))
            if s < e and not any(x < e - a and s - a < y for _, x, y in taken[row]):
                added[row].append((int(labels[i]) - 1, *_points(points, a, s, e)))
    return base, added, offsets


def _points(points: np.ndarray, row: int, start: int, end: int) -> tuple[int, int]:
    return int(points[start] - points[row]), int(points[end] - points[row])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def _first_ranked(docs: DataFrame) -> DataFrame:
    """Rows of ``(text, rank)`` that hold the ``SAMPLE_ROWS`` first texts with a mark, and not many more.

    Ranks are uniform, so a bound on them that follows from the number of rows leaves few rows for the one
    task that sorts; where too few texts have a mark, the bound is raised.
    """
    ranked = docs.select("text", F.xxhash64("doc_id", "text").alias("rank"))
    share = min(1.0, CUT * SAMPLE_ROWS / max(1, docs.count()))
    while True:
        bound = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
        part = ranked.where(F.col("rank") <= bound).where(F.col("text").rlike("[0-9@+]"))
        if share >= 1 or part.count() >= SAMPLE_ROWS:
            return part
        share = min(1.0, share * CUT)


def train(docs: DataFrame) -> Field:
    """Fit to the marked tokens of at most ``SAMPLE_ROWS`` texts, the first by a hash."""
    sample = _first_ranked(docs).orderBy("rank", "text").limit(SAMPLE_ROWS)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches):
            words = texts.split_words(batch.column("text"))
            data, offsets = texts.utf8(batch.column("text"))
            chosen, run = marked_tokens(words)
            row_of = np.searchsorted(words.first, chosen, side="right") - 1
            shapes = [shape(data[words.starts[i] : words.ends[i]].tobytes()) for i in chosen]
            labels = np.zeros(len(chosen), np.int64)
            for row in np.unique(row_of).tolist():
                a, b = int(offsets[row]), int(offsets[row + 1])
                for kind, s, e in base_spans(data[a:b].tobytes()):
                    inside = (words.starts[chosen] < a + e) & (words.ends[chosen] > a + s)
                    labels[inside & (row_of == row)] = kind + 1
            rank = batch.column("rank").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rank[row_of] if len(chosen) else rank[:0]),
                    pa.array(run, pa.int64()),
                    pa.array(labels),
                    pa.array([list(s) for s in shapes], pa.list_(pa.int64())),
                ],
                names=["rank", "run", "label", "shape"],
            )

    schema = "rank long, run long, label long, shape array<long>"
    table = sample.mapInArrow(label, schema).toArrow()
    order = np.lexsort((np.arange(table.num_rows), table.column("run").to_numpy(), table.column("rank").to_numpy()))
    table = table.take(pa.array(order))
    rank, run = table.column("rank").to_numpy(), table.column("run").to_numpy()
    new = np.ones(len(run), np.int64)
    new[1:] = (rank[1:] != rank[:-1]) | (run[1:] != run[:-1])
    run = np.cumsum(new)
    shapes = [tuple(x) for x in table.column("shape").to_pylist()]
    return train_field(token_features(shapes, run), run, table.column("label").to_numpy())


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every row of ``docs(doc_id, text)``, with counts by kind.

    Offsets are code points, ends exclusive. Null and empty texts hold nothing. A null
    doc_id stays null; repeated rows answer alike; an empty table gives none. Counts and
    ``base_sha256`` are of the pattern matches, ``spans`` also names what the field adds.
    Added spans do not overlap those of the patterns. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches):
            base, added, _ = spans_of(batch.column("text"), shared.value)
            counts = [[sum(k == kind for k, _, _ in row) for row in base] for kind in range(4)]
            digests = [hashlib.sha256(written(row).encode()).hexdigest() for row in base]
            spans = [written(a + b) for a, b in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string"
    )
    return docs.select("doc_id", "text").mapInArrow(mark, schema)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span, overlapping ones together, replaced by the kind of the first in brackets."""
    out, last, covered = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if start >= covered:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        covered = max(covered, end)
        last = covered
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all found spans of ``text`` replaced; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.chunks(batches):
            base, added, _ = spans_of(batch.column("text"), shared.value)
            raw = batch.column("text").to_pylist()
            clean = [
                redact(t, a + b) if t is not None else None
                for t, a, b in zip(raw, base, added, strict=True)
            ]
            at = batch.schema.get_field_index("text")
            columns = batch.columns
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)

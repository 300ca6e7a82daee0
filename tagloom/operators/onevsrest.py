"""One-vs-rest logistic regression with elastic net: all classes in one pass over distinct vectors.

Records with equal slots and label are one row with a count. Each pass adds up, for every class at once,
loss, gradient and curvature of its problem (a proximal Newton step needs no more); the driver holds
classes x slots^2 numbers, solves the small penalised quadratics by coordinate descent, and halves a
step that did not lower the loss. A handful of passes replaces a fit per class with up to a hundred each.

Each binary problem is that of a two-class multinomial model whose penalties apply to the coefficients of
standardised slots, intercept free: with the difference b of the two vectors that is
``loss + l1 |b| + l2 / 2 b^2`` for l1 = r a and l2 = r (1 - a) / 2. Slots that never vary get no weight.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.patterns import (
    LINEAR_ELASTIC_NET,
    LINEAR_ITERATIONS,
    LINEAR_REGULARIZATION,
)
from tagloom.functions.ranking import best_index, label_at
from tagloom.shared import materialize

TOLERANCE = 1e-5


@dataclass(frozen=True)
class LinearModel:
    """``weights[c]`` and ``intercepts[c]`` score class ``labels[c]`` on raw slots."""

    labels: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    passes: int


def fit(
    docs: DataFrame,
    label_col: str,
    slots_col: str,
    regularization: float = LINEAR_REGULARIZATION,
    elastic_net: float = LINEAR_ELASTIC_NET,
    iterations: int = LINEAR_ITERATIONS,
) -> LinearModel:
    """Fit ``docs(label, slots array<double>)``; rows without label or slots teach nothing."""
    known = docs.where(F.col(label_col).isNotNull() & F.col(slots_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(slots_col).alias("slots")
    )
    distinct = materialize(known.groupBy("label", "slots").agg(F.count(F.lit(1)).alias("n")), "slot-vectors")
    rows = distinct.groupBy("label").agg(F.sum("n").alias("docs")).collect()
    if not rows:
        raise ValueError("no labelled document to learn from")
    labels = tuple(r.label for r in sorted(rows, key=lambda r: (-r.docs, r.label)))
    scale = _deviations(distinct)
    total = sum(r.docs for r in rows)
    l1, l2 = regularization * elastic_net, regularization * (1 - elastic_net) / 2
    kept = scale > 0
    d = int(kept.sum())
    # The last column is the intercept; it starts at the log odds of the class.
    beta = np.zeros((len(labels), d + 1))
    share = np.array([next(r.docs for r in rows if r.label == label) for label in labels]) / total
    beta[:, -1] = np.log(np.clip(share, 1e-12, 1 - 1e-12) / np.clip(1 - share, 1e-12, 1))
    step, best, done, passes = np.zeros_like(beta), np.full(len(labels), np.inf), np.zeros(len(labels), bool), 0
    while passes < iterations and not done.all():
        passes += 1
        loss, gradient, curvature = _pass(distinct, labels, scale, beta, total)
        loss += l1 * np.abs(beta[:, :-1]).sum(axis=1) + l2 / 2 * (beta[:, :-1] ** 2).sum(axis=1)
        for c in np.flatnonzero(~done):
            if loss[c] > best[c] + 1e-14:
                step[c] /= 2
                beta[c] -= step[c]
                done[c] = np.abs(step[c]).max() < TOLERANCE
                continue
            best[c] = loss[c]
            target = _minimum(beta[c], gradient[c], curvature[c], l1, l2)
            step[c] = target - beta[c]
            beta[c] = target
            done[c] = np.abs(step[c]).max() < TOLERANCE
    # The two classes of a binary problem share the difference evenly.
    weights = np.zeros((len(labels), len(scale)))
    weights[:, kept] = beta[:, :-1] / scale[kept] / 2
    return LinearModel(
        labels, tuple(map(tuple, weights.tolist())), tuple((beta[:, -1] / 2).tolist()), passes
    )


def _deviations(distinct: DataFrame) -> np.ndarray:
    """Sample deviation of every slot over all records."""
    each = distinct.select("n", F.posexplode("slots").alias("slot", "x"))
    mean = F.sum(F.col("n") * F.col("x")) / F.sum("n")
    rows = each.groupBy("slot").agg(
        F.sum("n").alias("n"), mean.alias("mean"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("square")
    ).collect()
    out = np.zeros(max((r.slot for r in rows), default=-1) + 1)
    for r in rows:
        spread = r.square - r.n * r.mean * r.mean
        out[r.slot] = np.sqrt(max(0.0, spread) / (r.n - 1)) if r.n > 1 and spread > 1e-9 * max(1.0, r.square) else 0.0
    return out


def _pass(
    distinct: DataFrame, labels: Sequence[str], scale: np.ndarray, beta: np.ndarray, total: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss, gradient and curvature of every class at ``beta``, over all records."""
    kept, classes, width = scale > 0, len(labels), beta.shape[1]
    place = {label: i for i, label in enumerate(labels)}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes, 1 + width + width * width))
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.hstack([slots[:, kept] / scale[kept], np.ones((batch.num_rows, 1))])
            n = batch.column(2).to_numpy().astype(float)
            own = np.array([place[label] for label in batch.column(0).to_pylist()])
            margins = x @ beta.T
            for c in range(classes):
                y = own == c
                m = margins[:, c]
                p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                sums[c, 0] += (n * (np.logaddexp(0, m) - y * m)).sum()
                sums[c, 1 : 1 + width] += (n * (p - y)) @ x
                sums[c, 1 + width :] += ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(classes, dtype=np.int32)), pa.array(list(sums), pa.list_(pa.float64()))],
            ["class", "sums"],
        )

    partial = distinct.select("label", "slots", "n").mapInArrow(summed, "class int, sums array<double>")
    # As many rows as the model has numbers, whatever the table's size.
    rows = (
        partial.select("class", F.posexplode("sums").alias("place", "value"))
        .groupBy("class", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    sums = np.zeros((classes, 1 + width + width * width))
    for r in rows:
        sums[r["class"], r.place] = r.value
    sums /= total
    return sums[:, 0], sums[:, 1 : 1 + width], sums[:, 1 + width :].reshape(classes, width, width)


def _minimum(
    beta: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l1: float, l2: float
) -> np.ndarray:
    """Minimum of the penalised quadratic around ``beta``, coordinate by coordinate."""
    out, slope = beta.copy(), gradient.copy()
    last = len(beta) - 1
    for _ in range(1000):
        moved = 0.0
        for j in range(len(beta)):
            bend = curvature[j, j] + 1e-12
            if j == last:
                new = out[j] - slope[j] / bend
            else:
                pull = bend * out[j] - slope[j]
                new = np.sign(pull) * max(0.0, abs(pull) - l1) / (bend + l2)
            change = new - out[j]
            if change:
                out[j] = new
                slope += curvature[:, j] * change
                moved = max(moved, abs(change))
        if moved < TOLERANCE / 100:
            break
    return out


def scores(model: LinearModel, slots: Column) -> Column:
    """One score per class, in label order."""
    rows = F.array(*[F.struct(F.lit(list(w)).alias("w"), F.lit(b).alias("b")) for w, b in zip(model.weights, model.intercepts)])
    return F.transform(
        rows,
        lambda row: F.aggregate(
            F.zip_with(row["w"], slots, lambda w, x: w * x), row["b"], lambda total, v: total + v
        ),
    )


def predict(model: LinearModel, docs: DataFrame, slots_col: str) -> DataFrame:
    """Adds ``prediction`` (the label index as a double) and ``predictedLabel``."""
    best = best_index(scores(model, F.col(slots_col)))
    return docs.withColumn("prediction", best.cast("double")).withColumn(
        "predictedLabel", label_at(best, model.labels)
    )


"""Quality classifier: naive Bayes log-count ratios and a linear hinge-loss model.

Counts of every feature in each class come from all labelled training rows, as
a grouped sum; a text counts once for each label. A fourth of the texts, chosen
by hash, is kept out of these counts and of the fit: the curve from margins to
probabilities is drawn through it. The ratios scale the binary features; the
hinge-loss model is fitted by dual coordinate descent on a sample of at most
``most`` texts a class (those of the smallest hashes), and its weights are drawn
towards their mean size as is usual for this model. Scoring is one pass over the documents,
without a shuffle of texts; training shuffles them only where there are more
than ``BROADCAST_LABELS`` labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import private, random_rows, stored, table
from .features import SIZE, calibrate, feature_rows, features, in_fold, keep_rows, score_rows

SAMPLE = 4000
BROADCAST_LABELS = 2_000_000
FOLDS, HELD = 5, 0
CUT = 0.3
UNSEEN = "pmod(shiftright(h, 32), 4) = 0"


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """(text, y, h): training rows. Null labels, null ids and held-out ids are no training rows.

    Ids that are labelled both ways count for both. ``h`` names the text and
    orders rows at random, the same in each run; rows that repeat share it.
    """
    known = private(labels, "doc_id", column).where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("y")).where(~in_fold(F.col("_id"), folds, held)).distinct()
    rows = private(docs, "doc_id", "text")
    if known.count() <= BROADCAST_LABELS:  # 12 bytes each; beyond, texts are shuffled to their labels
        known = F.broadcast(known)
    return rows.join(known, F.col("doc_id") == F.col("_id")).select("text", "y", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def sample(rows: DataFrame, most: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and ``unseen`` of at most ``most`` rows a class; all that comes to the driver."""
    x, y, unseen = [], [], []
    for label in (0, 1):
        for row in random_rows(rows.where(F.col("y") == label), most).select("x", F.expr(UNSEEN).alias("unseen")).collect():
            x.append(np.frombuffer(row.x, np.int32))
            y.append(label)
            unseen.append(row.unseen)
    return x, np.array(y), np.array(unseen, bool)


def log_count_ratio(rows: DataFrame) -> np.ndarray:
    """log((a / |a|) / (b / |b|)) with a, b the smoothed numbers of rows with each feature in class 1 and 0."""
    size = SIZE

    def partial(batches):
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y").to_pylist()):
                total[int(y == 1), np.frombuffer(x.as_py(), np.int32)] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["i", "b", "a"])

    counts = rows.mapInArrow(partial, "i int, b long, a long").groupBy("i").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    a, b = np.ones(size), np.ones(size)
    for row in counts.toLocalIterator():  # at most ``SIZE`` rows
        a[row.i] += row.a
        b[row.i] += row.b
    return np.log((a / a.sum()) / (b / b.sum()))


def dual_descent(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 5):
    """Weights and bias of the hinge-loss model on features scaled by ``scale``, classes weighing the same."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(scale)), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, (y == 1).sum(), (y == 0).sum())
    upper = cost * len(y) / (2.0 * share)
    norm = np.array([1 / np.sqrt(max(1, len(v))) for v in x])
    values = [scale[v] * n for v, n in zip(x, norm)]
    square = np.array([(v * v).sum() + 1.0 for v in values])
    alpha = np.zeros(len(y))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(y)):
            gradient = sign[i] * (w[x[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x[i]] += step * values[i]
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held: int = HELD, pull: float = 0.75,
        most: int = SAMPLE) -> dict:
    """The fitted model, for ``score_rows``.

    With labels of one kind only, or none, all weights are 0 and the score is
    the share of label 1 among the labels (0.5 without any). Where a class has
    texts on one side of the split alone, counts, fit and curve use all texts.
    """
    rows = stored(feature_rows(labelled(docs, labels, column, folds, held), "y", "h").dropDuplicates(["y", "h"]), "quality-rows")
    x, y, unseen = sample(rows, most)
    if len(y) == 0 or y.min() == y.max():
        share = (y.mean() if len(y) else 0.5)
        return {"weights": np.zeros(SIZE), "bias": 0.0, "norm": True, "extract": features, "slope": 0.0, "offset": float(np.log((share + 1e-9) / (1 - share + 1e-9)))}
    split = all(len(np.unique(unseen[y == label])) == 2 for label in (0, 1))
    ratio = log_count_ratio(rows.where(f"NOT ({UNSEEN})") if split else rows)
    seen = ~unseen if split else np.ones(len(y), bool)
    checked = unseen if split else seen
    w, bias = dual_descent([v for v, p in zip(x, seen) if p], y[seen], ratio)

    def drawn(w):
        used = w != 0
        mean = np.abs(w[used]).mean() if used.any() else 0.0
        return (pull * w + (1 - pull) * mean * used) * ratio

    weights = drawn(w)
    margins = np.array([weights[v].sum() / np.sqrt(max(1, len(v))) + bias for v, p in zip(x, checked) if p])
    slope, offset = calibrate(margins, y[checked])
    return {"weights": weights, "bias": bias, "norm": True, "extract": features, "slope": slope, "offset": offset}


def judge(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held: int = HELD, cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty and get a score as well. Null ids are scored, and
    are never training rows. Repeated rows get a row each. No rows give no rows.
    """
    scores = score_rows(docs, fit(docs, labels, column, folds, held))
    return scores.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score",
                         F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; the same columns. Texts are scored where they are, without a shuffle."""
    return keep_rows(docs, fit(docs, labels), cut)


def op5_quality_classifier(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

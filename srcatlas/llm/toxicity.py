"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic; the unlabelled set is drawn from
all documents. The risk is prior * R+(f) + max(0, R-u(f) - prior * R-p(f)) for
the logistic loss: where the corrected negative part of a mini-batch falls
below zero the step goes back along it, so that the model cannot win by calling
unlabelled positives negative. The class prior is the share of toxic rows among
all labelled training rows.

Features are words and word beginnings. Those that positives do not have
clearly more often than unlabelled documents are left out of the model.

Both samples are bounded (``positives`` and ``free`` texts of the smallest
hashes, each text once); the prior counts every training label, a text once for
each; scoring is one pass over the
documents without a shuffle of texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import private, random_rows, stored, table
from .features import SIZE, calibrate, feature_rows, in_fold, roots, score_rows
from .quality import labelled

POSITIVES = 4000
UNLABELLED = 8000
FOLDS, HELD = 4, 2
CUT = 0.3


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], ratio: float = 2.0, z: float = 4.0) -> np.ndarray:
    """Which features positives have at least ``ratio`` times as often as unlabelled documents, by ``z`` standard errors."""
    p = np.bincount(np.concatenate(positive), minlength=SIZE)
    u = np.bincount(np.concatenate(unlabelled), minlength=SIZE) if unlabelled else np.zeros(SIZE)
    rate = (u + 1) / (len(unlabelled) + 2)
    surplus = (p - rate * len(positive)) / np.sqrt(rate * (1 - rate) * len(positive) + 1e-9)
    return (p >= 3) & (p / len(positive) > ratio * u / max(1, len(unlabelled))) & (surplus > z)


def nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 60, batch: int = 512,
          rate: float = 0.3, decay: float = 1e-4, seed: int = 2) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model by AdaGrad on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w, b, gw, gb = np.zeros(SIZE), -1.0, np.full(SIZE, 1e-3), 1e-3

    def margins(rows):
        return np.array([w[x].sum() + b for x in rows])

    def sigmoid(m):
        return 1 / (1 + np.exp(-np.clip(m, -500, 500)))

    steps = max(1, len(unlabelled) // batch)
    per = max(1, min(len(positive), batch // 2))
    for _ in range(rounds):
        order = rng.permutation(len(unlabelled))
        for s in range(steps):
            u = [unlabelled[i] for i in order[s::steps]]
            p = [positive[i] for i in rng.choice(len(positive), per, replace=False)]
            mu, mp = margins(u), margins(p)
            negative = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
            du, dn, dp = sigmoid(mu) / len(u), -prior * sigmoid(mp) / len(p), -prior * sigmoid(-mp) / len(p)
            if negative >= 0:
                parts = [(u, du), (p, dn + dp)]
            else:  # the corrected part is below zero: step back along it only
                parts = [(u, -du), (p, -dn)]
            at = np.concatenate([x for rows, _ in parts for x in rows])
            by = np.concatenate([np.full(len(x), d) for rows, ds in parts for x, d in zip(rows, ds)])
            used, place = np.unique(at, return_inverse=True)
            g = np.bincount(place, by, minlength=len(used)) + decay * w[used]
            gw[used] += g * g
            w[used] -= rate * g / np.sqrt(gw[used])
            slope = sum(d.sum() for _, d in parts)
            gb += slope * slope
            b -= rate * slope / np.sqrt(gb)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held: int = HELD,
        positives: int = POSITIVES, free: int = UNLABELLED) -> dict:
    """The fitted model, for ``score_rows``. Without any positive the score is 0 for all."""
    rows = stored(labelled(docs, labels, column, folds, held), "toxic-rows")
    known = rows.select("y", "h").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).first()
    if not known["toxic"]:
        return {"weights": np.zeros(SIZE), "bias": 0.0, "norm": False, "extract": roots, "slope": 0.0, "offset": -500.0}
    prior = known["toxic"] / known["n"]

    def fetched(part: DataFrame, most: int, label: str) -> list[tuple[np.ndarray, int]]:
        few = random_rows(part, most).select(F.coalesce("text", F.lit("")).alias("text"), label)
        return [(np.frombuffer(r.x, np.int32), r[label]) for r in feature_rows(few, label, extract=roots).collect()]

    positive = [x for x, _ in fetched(rows.where("y = 1"), positives, "y")]
    # unlabelled: any documents outside the held-out fold, whatever their labels
    anything = private(docs, "doc_id", "text").where(~in_fold(F.col("doc_id"), folds, held)).select(
        "text", F.lit(0).alias("y"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(2)).alias("h"))
    unlabelled = [x for x, _ in fetched(anything, free, "y")]
    part = np.arange(len(positive)) % 4 == 0 if len(positive) >= 40 else np.zeros(len(positive), bool)
    fitted = [x for x, p in zip(positive, part) if not p]
    keep = telling(fitted, unlabelled)
    w, b = nn_pu([x[keep[x]] for x in fitted], [x[keep[x]] for x in unlabelled], prior)
    # The curve from margins to probabilities is fitted on labelled rows, positives unseen by the fit.
    checks = [(x, 1) for x, p in zip(positive, part) if p or not part.any()]
    checks += [(x, 0) for x, _ in fetched(rows.where("y = 0"), positives, "y")]
    margins = np.array([w[x].sum() + b for x, _ in checks])
    slope, offset = calibrate(margins, np.array([y for _, y in checks]))
    return {"weights": w, "bias": b, "norm": False, "extract": roots, "slope": slope, "offset": offset}


def judge(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD, cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty and get a score as well. Null ids are scored and
    are never labelled. Repeated rows get a row each. No rows give no rows.
    """
    scores = score_rows(docs, fit(docs, labels, "toxic", folds, held))
    return scores.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"), "score",
                         F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def op2_toxicity(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Hashed text features and what both classifiers share."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import private, small_batches

BITS = 18
SIZE = 1 << BITS
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x20\x30-\x39\x41-\x5A\x61-\x7A\x7F-\xFF]")
LETTERS = re.compile(r"[^\W_]+")


def in_fold(doc_id: Column, folds: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves ``held``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == held


def features(text: str | None) -> np.ndarray:
    """Sorted indices of the words (lower-cased), word pairs, signs, and letter shapes that occur in a whole text.

    Case patterns and the shares of signs and capitals are features too, as
    they tell prose from shouting and lists.
    """
    raw = (text or "").encode()
    tokens = WORD.findall(raw)
    found = set()
    low = [t.lower() for t in tokens]
    crc = zlib.crc32
    codes = [crc(t) for t in low]
    found.update(codes)
    found.update((a * 0x9E3779B1 + b) & 0xFFFFFFFF for a, b in zip(codes, codes[1:]))
    signs = sum(1 for t in tokens if not t[:1].isalnum() and t[0] < 128)
    upper = sum(1 for t in tokens if t.isupper())
    n = max(1, len(tokens))
    for name, value in (("signs", signs), ("upper", upper), ("kinds", len(set(low)))):
        found.add(crc(f"\x00{name}{int(10 * value / n)}".encode()))
    found.add(crc(f"\x00long{len(tokens).bit_length()}".encode()))
    return _indices(found)


def roots(text: str | None) -> np.ndarray:
    """Sorted indices of the words of a whole text, lower-cased, and of their first 4, 5 and 6 letters.

    Inflected forms of a word that training never saw share its beginning.
    """
    found = set()
    crc = zlib.crc32
    for word in set(LETTERS.findall((text or "").lower())):
        found.add(crc(word.encode()))
        for n in (4, 5, 6):
            if len(word) >= n:
                found.add(crc(f"^{word[:n]}".encode()))
    return _indices(found)


def _indices(codes: set[int]) -> np.ndarray:
    mixed = np.fromiter(codes, np.uint64, len(codes)) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed >> np.uint64(64 - BITS)).astype(np.int32)


def feature_rows(rows: DataFrame, *keep: str, extract: Callable = features) -> DataFrame:
    """The ``keep`` columns and ``x``, the features of ``text`` as 4-byte integers."""
    small_batches(rows.sparkSession)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", x binary"

    def each(batches):
        for batch in batches:
            x = pa.array([extract(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], x], [*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(each, schema)


def _score(text: str | None, model: dict) -> float:
    x = model["extract"](text)
    margin = model["weights"][x].sum() / (np.sqrt(max(1, len(x))) if model["norm"] else 1.0) + model["bias"]
    return float(1.0 / (1.0 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -500, 500))))


def score_rows(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of each row: logistic of slope * margin + offset; the margin is bias plus the weights of its features.

    ``model``: weights (SIZE), bias, norm (divide by the root of the number of
    features), slope, offset, extract (text to feature indices). Its size is fixed.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = private(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for batch in batches:
            out = [_score(t.as_py(), shared.value) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(each, f"doc_id {kind}, score double")


def keep_rows(docs: DataFrame, model: dict, cut: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, with all their columns; where they lie, without a shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            yield batch.filter(pa.array([_score(t.as_py(), shared.value) >= cut for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps on smoothed targets)."""
    if len(margins) == 0 or labels.min() == labels.max():
        return 1.0, 0.0
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins / (margins.std() + 1e-12), np.ones(len(margins))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-6 * theta)
        theta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / (margins.std() + 1e-12)), float(theta[1])

"""Whitening of embeddings on a grid, with covariances by polarisation.

Entries are put on the integer grid x = floor(64 * c) + 1000000, and each
distinct grid vector counts once in the fit. With n vectors and sums S, the
centred values n * x - S are integers. For every dimension j and every pair of
dimensions j < k the exact sums of squares of the centred value and of the sum
of the two are aggregated; a covariance is half the difference of the pair's sum
of squares and the two own ones. No product of two dimensions is ever formed,
and nothing is rounded before the one division that makes an entry of the
matrix. Only those d * (d + 1) / 2 sums come to the driver, for ``eigh``.

Every pass keeps rows where they lie but one, the shuffle that finds distinct
vectors; equal ones are combined before it.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import private, stored, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
ROWS = 1024
LEAST = 1e-12
HALF = 26
BASE = 10 ** 18


def _grid(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vector in a column: the rows that are whole, and their grid vectors."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    starts = np.cumsum(lengths) - lengths
    out = []
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        c = values[starts[rows][:, None] + np.arange(d)]
        x = np.floor(SCALE * c)
        whole = (np.abs(x) < 2.0 ** 62).all(1)  # false for NaN and infinities; beyond it there is no long
        out.append((rows[whole], x[whole].astype(np.int64) + SHIFT))
    return out


def _vectors(rows: DataFrame) -> DataFrame:
    """(x): the distinct grid vectors, as 8-byte integers."""
    def each(batches):
        for batch in batches:
            for _, x in _grid(batch.column("v")):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return rows.select("v").mapInArrow(each, "x binary").distinct()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of fit vectors and their exact sum in each dimension."""
    def each(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            x = _matrix(batch.column("x"))
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)],
                                             ["j", "n", "high", "low"])

    parts = fit.mapInArrow(each, "j long, n long, high long, low long").groupBy("j").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    rows = sorted(parts.collect())  # a row for each dimension
    return rows[0].n, [(int(r.high) << 32) + int(r.low) for r in rows]


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they surely fit, else as Python's."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, s), default=0)
    if most < 1 << 62:
        return x * n - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def square_sums(p: np.ndarray) -> list[int]:
    """Exact sums of squares of the columns of a matrix of at most ``ROWS`` rows."""
    if p.dtype == object or int(np.abs(p).max(initial=0)) >= 1 << (2 * HALF):
        return (p.astype(object) ** 2).sum(0).tolist()
    high, low = p >> HALF, p & ((1 << HALF) - 1)  # each square and product is below 2**52
    parts = [np.einsum("ij,ij->j", u, v).tolist() for u, v in ((high, high), (high, low), (low, low))]
    return [(a << (2 * HALF)) + (b << (HALF + 1)) + c for a, b, c in zip(*parts)]


def _squares(fit: DataFrame, n: int, s: list[int]) -> list[int]:
    """Sums of squares over the fit list: of each dimension's centred value, then of each pair's sum, row after row."""
    d = len(s)

    def each(batches):
        total = [0] * (d * (d + 1) // 2)
        for batch in batches:
            x = _matrix(batch.column("x"))
            for start in range(0, len(x), ROWS):
                y = centred(x[start:start + ROWS], n, s)
                found = square_sums(y)
                for j in range(d - 1):
                    found += square_sums(y[:, j:j + 1] + y[:, j + 1:])
                total = [a + b for a, b in zip(total, found)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(total))), pa.array([Decimal(t // BASE) for t in total], pa.decimal128(38, 0)),
            pa.array([t % BASE for t in total], pa.int64())], ["i", "high", "low"])

    parts = fit.mapInArrow(each, "i long, high decimal(38,0), low long").groupBy("i").agg(
        F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return [int(r.high) * BASE + int(r.low) for r in sorted(parts.collect())]


def covariance(squares: list[int], n: int, d: int) -> np.ndarray:
    """The covariance matrix (divisor n) by polarisation of exact sums of squares; each entry is rounded once."""
    v = np.empty((d, d))
    pair = d
    for j in range(d):
        v[j, j] = squares[j] / n ** 3
        for k in range(j + 1, d):
            v[j, k] = v[k, j] = (squares[pair] - squares[j] - squares[k]) / (2 * n ** 3)
            pair += 1
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as columns, eigenvalues, shares of the trace), by falling eigenvalue; those of (nearly) no variance left out."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    kept = min(most, int((e > LEAST * max(e[0], 0.0)).sum()) if e[0] > 0 else 0)
    e, u = e[:kept], u[:, :kept]
    if kept:
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(kept)] < 0, -1.0, 1.0)
    return u, e, e / np.trace(v) if kept else e


def _project(y: np.ndarray, n: int, u: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (y.astype(np.float64) / n) @ (u / np.sqrt(e))


def _identity_error(fit: DataFrame, n: int, s: list[int], u: np.ndarray, e: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit vectors, less the identity."""
    k = len(e)

    def each(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            y = centred(_matrix(batch.column("x")), n, s)
            w = np.column_stack((_project(y, n, u, e), np.ones(len(y))))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    parts = fit.mapInArrow(each, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = np.array([r.v for r in sorted(parts)]).reshape(k + 1, k + 1)
    mean = m[k, :k] / n
    return float(np.abs(m[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """For each row (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries (or
    entries without a place on the grid of longs) give no rows. All vectors must
    have one length; where they do not, the length that most distinct vectors
    have is fitted (the longer one at a tie) and the others give no rows, as they
    are of another space. There are as many components as dimensions, at most
    ``most``, without those of no variance: equal vectors, or a single one, give
    no rows. ``deviation`` is null where it is no 64-bit number. Rows that
    repeat, ids or vectors, get rows of their own; null ids stay null.
    """
    spark = rows.sparkSession
    rows = private(rows, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double,"
              " explained double, identity_error double")
    distinct = stored(_vectors(rows), "grid")
    lengths = distinct.groupBy((F.octet_length("x") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    usual = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    d = usual.d
    fit = distinct.where(F.octet_length("x") == 8 * d)
    n, s = _sums(fit)
    u, e, explained = components(covariance(_squares(fit, n, s), n, d), most)
    if not len(e):
        return spark.createDataFrame([], schema)
    error = _identity_error(fit, n, s, u, e)

    def each(batches):
        k = len(e)
        for batch in batches:
            for at, x in _grid(batch.column("v")):
                if not len(x) or x.shape[1] != d:
                    continue
                y = centred(x, n, s)
                fits = y.dtype != object and int(np.abs(y).max()) ** 2 * d < 1 << 63
                far = (y * y).sum(1) if fits else (y.astype(object) ** 2).sum(1)
                far = pa.array([v if v < 1 << 63 else None for v in far.tolist()], pa.int64())
                row = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(k * len(at), n)), far.take(row), pa.array(_project(y, n, u, e).ravel()),
                    pa.array(np.tile(explained, len(at))), pa.array(np.full(k * len(at), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(each, schema)


def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))

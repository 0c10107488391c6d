"""Embedding whitening by a cyclic Jacobi eigenvalue solver.

Entries become integers on a fixed grid, x = floor(1024 * c) + 100000. One pass sums them exactly, a second one sums
the products of the centred vectors (the scatter) block by block in the tasks and by cell on the executors; the driver
sees one matrix of the dimension squared. There cyclic Jacobi rotations run until every off-diagonal entry is
negligible beside the two diagonal entries that it joins, which keeps small eigenvalues accurate relative to
themselves and not only to the largest one. The whitening matrix, sorted by falling eigenvalue, is broadcast: its size
depends on the dimension alone.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors of
another length than the commonest (of equally common ones the longest); a null id is carried; repeated rows each count
and each return; components whose eigenvalue is rounding noise beside the largest (below dimension * 2**-52 of it) have
no direction and are left out, so equal vectors, or one vector, give no rows; an empty table gives none. Entries beyond
2**50 on the grid are held at that bound. `deviation` is null where it exceeds 64 bits; `deviation_exact` has its digits always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

GRID, SHIFT, BOUND = 1024.0, 100_000, 1 << 50
#: Sums of x are kept in two parts, x = high * 2**25 + low, so that no sum of fewer than 2**38 rows exceeds 64 bits.
_LOW = 25
#: Rows that are multiplied in one go.
BLOCK = 4096
#: More sweeps than this have never been needed; a matrix that asks for more is not symmetric or not finite.
MAX_SWEEPS = 100


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, eigenvectors as columns) of a symmetric positive semidefinite matrix.

    Rows p and q are rotated unless their joint entry is below rounding beside sqrt(a_pp * a_qq); a sweep without a
    rotation ends. Each eigenvector's largest entry (of equal ones the first) is made positive.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    vectors = np.eye(d)
    small = 2.0**-52 * np.sqrt(d)
    floor = np.finfo(np.float64).tiny
    for _ in range(MAX_SWEEPS):
        rotated = False
        for p in range(d - 1):
            # rotations in row p change its later entries, so each is looked at when its turn comes
            for q in range(p + 1, d):
                apq = a[p, q]
                if abs(apq) <= small * np.sqrt(abs(a[p, p] * a[q, q])) or abs(apq) < floor:
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * apq)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                app, aqq = a[p, p] - t * apq, a[q, q] + t * apq
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                vp = vectors[:, p].copy()
                vectors[:, p], vectors[:, q] = c * vp - s * vectors[:, q], s * vp + c * vectors[:, q]
        if not rotated:
            break
    else:
        raise ArithmeticError("the rotations did not end: not a finite symmetric matrix")
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    at = np.argmax(np.abs(vectors), axis=0) if d else np.zeros(0, int)
    return values[order], vectors * np.where(vectors[at, np.arange(d)] < 0, -1.0, 1.0)


def _valid(vector: Column) -> Column:
    return (F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _grid(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """(rows, d) of x, as 64-bit integers."""
    c = pc.list_flatten(batch.column("vector")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.clip(np.floor(c * GRID), -BOUND, BOUND).astype(np.int64) + SHIFT


def _cells(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"cell": pa.array(range(len(next(iter(totals.values())))), pa.int64())} | {k: pa.array(v) for k, v in totals.items()})


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sums by dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _grid(batch, d)
            n += len(x)
            high += (x >> _LOW).sum(0)
            low += (x & ((1 << _LOW) - 1)).sum(0)
        if n:
            yield _cells({"n": np.full(d, n), "high": high, "low": low})

    cells = rows.mapInArrow(run, "cell long, n long, high long, low long").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect()
    by = {r["cell"]: r for r in cells}
    return (by[0]["n"], [(by[i]["high"] << _LOW) + by[i]["low"] for i in range(d)]) if by else (0, [0] * d)


def _scatter(rows: DataFrame, d: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Sum over all rows of the outer product of x - mean, after a projection where one is given."""
    k = d if project is None else project.shape[1]
    ship = rows.sparkSession.sparkContext.broadcast((mean, project))
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, project = ship.value
        total, any_rows = np.zeros((k, k)), False
        for batch in batches:
            x = _grid(batch, d)
            any_rows |= len(x) > 0
            for i in range(0, len(x), BLOCK):
                y = x[i : i + BLOCK] - mean
                y = y if project is None else y @ project
                total += y.T @ y
        if any_rows:
            yield _cells({"v": total[upper]})

    out = np.zeros((k, k))
    for r in rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        out[i, j] = out[j, i] = r["v"]
    return out


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each kept vector and component.

    identity_error is measured on the whitened values themselves, in a pass of its own.
    """
    id_type = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(_valid(F.col("vector")))
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return table.sparkSession.createDataFrame([], schema)
    d = common["d"]
    rows = rows.where(F.size("vector") == d)
    n, total = _sums(rows, d)
    mean = np.array([s / n for s in total])
    covariance = _scatter(rows, d, mean) / n
    values, vectors = jacobi(covariance)
    k = int(np.sum(values[:components] > d * 2.0**-52 * max(values[0], 0.0)))
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    project = vectors[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / np.trace(covariance)
    error = float(np.abs(_scatter(rows, d, mean, project) / n - np.eye(k)).max())
    ship = rows.sparkSession.sparkContext.broadcast((mean, project, explained, total))
    parts = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, project, explained, total = ship.value
        # S = n * base + rest, so n * x - S = n * (x - base) - rest stays an exact integer
        base = np.array([s // n for s in total], np.int64)
        rest = np.array([s % n for s in total], object)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = _grid(part, d)
                if not len(x):
                    continue
                w = (x - mean) @ project
                y = x - base
                # sum (n*y - r)**2 = n*n*sum(y*y) - 2*n*sum(y*r) + sum(r*r), of Python integers where 64 bits may not do
                if np.abs(y).max() < parts:
                    squares = (y * y).sum(1).astype(object)
                    high, low = rest // (1 << 20), rest % (1 << 20)
                    cross = (y @ low.astype(np.int64)).astype(object) + (y @ high.astype(np.int64)).astype(object) * (1 << 20) if n < 1 << 60 else (y.astype(object) * rest).sum(1)
                else:
                    squares, cross = (y.astype(object) ** 2).sum(1), (y.astype(object) * rest).sum(1)
                exact = [int(v) for v in n * n * squares - 2 * n * cross + int((rest * rest).sum())]
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        pa.array([v if v < 1 << 63 else None for v in exact for _ in range(k)], pa.int64()),
                        pa.array(w.reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                        pa.array([str(v) for v in exact for _ in range(k)], pa.string()),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return rows.mapInArrow(run, schema)

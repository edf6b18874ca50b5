"""Whitening of embeddings by spectrum slicing.

The covariance is taken exactly, in whole numbers, over each distinct vector
once. Its leading eigenvalues are told apart by inertia: the signs of the pivots
of a symmetric factorisation L D L' of the covariance minus a shift count the
eigenvalues above the shift (Sylvester). Bisection by these counts isolates each
eigenvalue, Rayleigh quotient iteration then converges cubically inside the
isolating interval, and two more counts just above and below the result certify
its number. Only sums of d x d values leave the executors, d being the length of
a vector; the table itself is read where it lies.

Rows whose vector is null or holds null, infinite or undefined components take
no part, nor do vectors of another length than most have (of equally common
lengths the shorter counts). A null id is kept as null. Repeated rows are
answered each, and count once in the fit; an empty table gives an empty result.
Components without variance (rank lower than asked, one row, constant columns)
are left out. ``deviation`` is null where it doesn't fit 64 bits. Other columns
of the table, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_matrix, whole_vectors

_EPS = float(np.finfo(np.float64).eps)
#: Growth bound of pivots that stay 1 x 1 (Bunch and Kaufman, 1977).
_ALPHA = (1.0 + math.sqrt(17.0)) / 8.0
_TOTAL = pa.decimal128(38, 0)


# --------------------------------------------------------------- spectrum


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive pivots of L D L' with 1 x 1 and 2 x 2 pivots."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        largest = below.max() if len(below) else 0.0
        head = abs(a[k, k])
        if head == 0.0 and largest == 0.0:
            k += 1  # an eigenvalue at the shift itself isn't above it
            continue
        single = head >= _ALPHA * largest
        if not single:
            r = k + 1 + int(np.argmax(below))
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            width = row.max()
            single = head * width >= _ALPHA * largest * largest
            if not single and abs(a[r, r]) >= _ALPHA * width:
                swap(k, r)
                single = True
            elif not single:
                swap(k + 1, r)
        if single:
            pivot, v = a[k, k], a[k + 1 :, k].copy()
            positive += pivot > 0
            a[k + 1 :, k + 1 :] -= np.outer(v, v) / pivot
            k += 1
        else:  # such a block has one eigenvalue of either sign
            (p, q), r = a[k, k : k + 2], a[k + 1, k + 1]
            x, y = a[k + 2 :, k].copy(), a[k + 2 :, k + 1].copy()
            positive += 1
            cross = np.outer(x, y)
            # Symmetric in every bit, so that no later block can be singular.
            a[k + 2 :, k + 2 :] -= ((r / q) * np.outer(x, x) + (p / q) * np.outer(y, y) - (cross + cross.T)) / ((p / q) * r - q)
            k += 2
    return int(positive)


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, _EPS * scale, 16 * _EPS * scale):
        try:
            y = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), x)
        except np.linalg.LinAlgError:
            continue
        if np.all(np.isfinite(y)):
            return y / np.linalg.norm(y)
    return x


def _free(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``x`` without its parts along the vectors found, of length 1."""
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
    return x / np.linalg.norm(x)


def leading_eigenpairs(matrix: np.ndarray, count: int) -> list[tuple[float, np.ndarray]]:
    """The ``count`` largest eigenvalues with unit eigenvectors, in falling order, each numbered by inertia counts."""
    d = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if scale == 0.0:
        return []
    slack = 8 * d * _EPS * scale
    counts: dict[float, int] = {scale * (1 + 1e-9): 0, -scale * (1 + 1e-9): d}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    pairs: list[tuple[float, np.ndarray]] = []
    start = np.random.Generator(np.random.PCG64(12)).standard_normal((min(count, d), d))
    for j in range(1, min(count, d) + 1):
        found = [v for _, v in pairs]
        low = max(s for s, c in counts.items() if c >= j)
        high = min(s for s, c in counts.items() if c < j)
        ratio = 0.05  # how narrow the interval must be before the iteration starts
        while True:
            while high - low > slack and (above(low) != j or above(high) != j - 1 or high - low > ratio * max(abs(high), slack)):
                middle = 0.5 * (low + high)
                low, high = (middle, high) if above(middle) >= j else (low, middle)
            x, shift = _free(start[j - 1], found), 0.5 * (low + high)
            for _ in range(3):
                x = _free(_solve(matrix, shift, x, scale), found)
            value = float(x @ (matrix @ x))
            for _ in range(12):  # Rayleigh quotient iteration
                if np.linalg.norm(matrix @ x - value * x) <= 2 * _EPS * scale:
                    break
                x = _free(_solve(matrix, value, x, scale), found)
                value = float(x @ (matrix @ x))
            if above(value + slack) < j <= above(value - slack):
                pairs.append((value, x))
                break
            if high - low <= slack:
                raise ArithmeticError(f"eigenvalue {j} isn't certified by inertia counts")
            ratio *= 0.01  # it ran to another eigenvalue: begin nearer
    return pairs


# --------------------------------------------------------------------- fit


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums`` by dimension; eigenvalues and unit eigenvectors (rows) of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - S/n) on each component, over the root of its eigenvalue."""
        middle = np.array([_nearest(s, self.n) for s in self.sums], dtype=np.int64)
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, middle, strict=True)])
        return ((x - middle).astype(np.float64) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def _nearest(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def _exact_sums(distinct: DataFrame, products: bool, middle: list[int] | None = None) -> dict[tuple[int, int], int]:
    """Exact sums over all rows: of each dimension (j = -1) and, with ``products``, of products of dimensions less ``middle``; n stands at (-1, -1)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        n, held, room = 0, None, 0.0

        def flush() -> None:
            nonlocal held, room
            if held is not None:
                for (i, j), v in np.ndenumerate(held):
                    if i <= j or not products:
                        at = (i, j) if products else (j, -1)
                        totals[at] = totals.get(at, 0) + int(v)
            held, room = None, 0.0

        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_matrix(batch.column(0))
            n += len(x)
            largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            if middle is not None:
                largest += max(map(abs, middle), default=0)
            need = float(largest) ** (2 if products else 1) * len(x)
            z = (x if need < 2.0**62 else x.astype(object)) - (0 if middle is None else np.array(middle, dtype=np.int64 if need < 2.0**62 else object))
            if products:
                # Whole numbers below 2^53 are exact in doubles, so the fast product is exact too.
                one = (z.astype(np.float64).T @ z.astype(np.float64)).astype(np.int64) if need < 2.0**53 else z.T @ z
            else:
                one = z.sum(axis=0)[None, :]
            if room + need >= 2.0**62:
                flush()
            held, room = (one if held is None else held + one), room + need
        flush()
        if n:
            totals[(-1, -1)] = n
            keys = list(totals)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(totals[k]) for k in keys], _TOTAL)], ["i", "j", "total"])

    parts = distinct.select("x").mapInArrow(part, "i int, j int, total decimal(38,0)")
    # One row for each pair of dimensions, so their number is bounded by the length of a vector.
    return {(r["i"], r["j"]): int(r["total"]) for r in parts.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}


def fit_whitening(distinct: DataFrame, components: int = 4) -> Whitening | None:
    """Whitening from a table ``x`` of distinct vectors of one length; None if there is no variance."""
    first = _exact_sums(distinct, products=False)
    n = first.get((-1, -1), 0)
    d = sum(1 for i, j in first if i >= 0)
    if not n or not d:
        return None
    sums = [first[(i, -1)] for i in range(d)]
    middle = [_nearest(s, n) for s in sums]
    second = _exact_sums(distinct, products=True, middle=middle)
    rest = [s - n * c for s, c in zip(sums, middle, strict=True)]
    whole = [[n * second[(min(i, j), max(i, j))] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    # Quotients of whole numbers are rounded once, so the covariance doesn't depend on how rows were dealt.
    covariance = np.array([[v / (n * n) for v in row] for row in whole])
    trace = sum(whole[i][i] for i in range(d)) / (n * n)
    pairs = [(e, v) for e, v in leading_eigenpairs(covariance, components) if e > 16 * d * _EPS * trace]
    if not pairs:
        return None
    values = np.array([e for e, _ in pairs])
    return Whitening(n, sums, values, np.array([v for _, v in pairs]), values / trace)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of whitened vectors minus the identity, over the fit list."""
    k = len(model.values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            if batch.num_rows:
                w = model.project(whole_matrix(batch.column(0)))
                total += np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
        at = [(i, j) for i in range(k) for j in range(k + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([total[p] for p in at], pa.float64())], ["i", "j", "total"])

    got = distinct.select("x").mapInArrow(part, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros((k, k + 1))
    for r in got:
        sums[r["i"], r["j"]] = r["total"]
    mean = sums[:, k] / model.n
    return float(np.abs(sums[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    largest = n * float(np.abs(x).max(initial=0)) + float(max(map(abs, sums)))
    if largest * largest * len(sums) < 2.0**62:
        y = n * x - np.array(sums, dtype=np.int64)
        return pa.array(np.einsum("ij,ij->i", y, y), pa.int64())
    y = n * x.astype(object) - np.array(sums, dtype=object)
    return pa.array([v if v < 1 << 63 else None for v in (y * y).sum(axis=1)], pa.int64())


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum of (n * x - S)^2; the other columns are as in
    the module's text. What is shipped to tasks is one model of ``components``
    vectors, whatever the size of the table.
    """
    rows = whole_vectors(df, id_column, vector)
    kind = dict(rows.dtypes)["id"]
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = materialize(rows.select("x").distinct(), "whitening")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    length = sizes[0]["d"] if sizes else 0
    distinct = distinct.where(F.size("x") == length)
    model = fit_whitening(distinct, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    k = len(model.values)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_matrix(batch.column(1))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.n, dtype=np.int64)),
                    _deviations(x, model.n, model.sums).take(each),
                    pa.array(model.project(x).reshape(-1)),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == length).mapInArrow(answer, schema)

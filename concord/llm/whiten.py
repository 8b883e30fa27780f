"""Embedding whitening: decorrelated leading components of unit variance.

Vectors become whole numbers, floor(``scale`` * c). The fit takes every distinct vector once.
Three passes run over the distinct vectors: exact sums, the covariance of centred values in
partial matrices added up in a tree, and the covariance of what comes out. Only matrices of
dimensions x dimensions reach the driver, where the covariance is made tridiagonal by
Householder reflections, the leading eigenvalues are found by bisection with Sturm counts,
and their vectors by inverse iteration, orthogonal within clusters of close eigenvalues. The
components go to the tasks, which project every row.

Vectors that are null or empty, or hold null or non-finite entries or ones too large for the sums
(2**53 or more in size once scaled), are dropped. Null ids are kept; repeated rows are
projected again and count once in the fit. Equal eigenvalues get orthogonal components of
their space. Components without variance (their eigenvalue is rounding of the largest) do not
exist, so vectors that are all equal, or a single one, give no rows, and neither does an empty
table. Vectors of different lengths are an error. ``deviation`` is null where it does not fit
64 bits. Other columns, whatever their names, are left out. There is no text here.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.moments import ROW, partial, stack, tree_sum
from concord.sources.paths import discard, materialize

#: Most numbers of a covariance that the driver decomposes.
MOST_DIMENSIONS = 4096
#: Entries whose scaled size reaches this are not kept.
TOO_LARGE = float(2**53)


# ---------------------------------------------------------------- symmetric eigenproblem


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of Q' A Q; reflector k acts on entries k + 1 on."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max()
        v = np.zeros_like(x)
        if size > 0 and np.abs(x[1:]).max() > 0:
            v = x / size
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            # A - v w' - w v' with w = 2 (A v - (v' A v) v)
            p = 2 * (a[k + 1 :, k + 1 :] @ v)
            w = p - (v @ p) * v
            a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] -= 2 * v * (v @ x)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def _below(d: np.ndarray, squares: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each of x: the negative
    terms of its Sturm sequence."""
    q = d[0] - x
    count = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[k] - x - squares[k - 1] / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each bisected to the last bits."""
    n = len(d)
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    low, high = float((d - reach).min()), float((d + reach).max())
    norm = max(abs(low), abs(high), 1e-300)
    squares, tiny = e * e, max(np.finfo(float).tiny, np.finfo(float).eps * norm * 1e-3)
    lows, highs = np.full(count, low - 1e-12 * norm), np.full(count, high + 1e-12 * norm)
    wanted = n - np.arange(count)  # the k-th largest has this many at or below it
    for _ in range(200):
        middle = (lows + highs) / 2
        above = _below(d, squares, middle, tiny) >= wanted
        highs, lows = np.where(above, middle, highs), np.where(above, lows, middle)
        if (highs - lows <= 2 * np.finfo(float).eps * np.maximum(np.abs(lows), np.abs(highs))).all():
            break
    return (lows + highs) / 2


def _factor(d: np.ndarray, e: np.ndarray, shift: float, tiny: float):
    """Rows of U and the row swaps and multipliers of T - shift I, with partial pivoting."""
    n = len(d)
    upper, steps = np.zeros((n, 3)), []
    row = [d[0] - shift, e[0] if n > 1 else 0.0, 0.0]
    for k in range(n - 1):
        below = [e[k], d[k + 1] - shift, e[k + 1] if k + 2 < n else 0.0]
        swap = abs(below[0]) > abs(row[0])
        if swap:
            row, below = below, row
        if abs(row[0]) < tiny:
            row[0] = tiny
        factor = below[0] / row[0]
        upper[k] = row
        steps.append((swap, factor))
        row = [below[1] - factor * row[1], below[2] - factor * row[2], 0.0]
    if abs(row[0]) < tiny:
        row[0] = tiny
    upper[n - 1] = row
    return upper, steps


def _solve(upper: np.ndarray, steps: list, b: np.ndarray) -> np.ndarray:
    x = b.astype(float).tolist()
    for k, (swap, factor) in enumerate(steps):
        if swap:
            x[k], x[k + 1] = x[k + 1], x[k]
        x[k + 1] -= factor * x[k]
    n = len(x)
    u = upper.tolist()
    for k in range(n - 1, -1, -1):
        x[k] -= (u[k][1] * x[k + 1] if k + 1 < n else 0.0) + (u[k][2] * x[k + 2] if k + 2 < n else 0.0)
        x[k] /= u[k][0]
        if abs(x[k]) > 1e200:  # only the direction counts
            x = [v * 1e-200 for v in x]
    return np.array(x)


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix in columns. Those of values closer than a
    thousandth of the norm are a cluster: each is kept orthogonal to the ones before it, and
    values that coincide are moved apart by a few units in the last place."""
    n, norm = len(d), max(float(np.abs(d).max() + (2 * np.abs(e).max() if len(e) else 0)), 1e-300)
    tiny, rnd = np.finfo(float).eps * norm, np.random.default_rng(1)
    out = np.zeros((n, len(values)))
    start, last = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        shift = value if last is None or k == start else min(value, last - 10 * np.finfo(float).eps * norm)
        last = shift
        upper, steps = _factor(d, e, shift, tiny)
        x = rnd.normal(size=n)
        best = np.inf
        for turn in range(12):
            x = x / np.linalg.norm(x)
            x = _solve(upper, steps, x)
            for _ in range(2):  # twice is enough
                x -= out[:, start:k] @ (out[:, start:k].T @ x)
            if not np.linalg.norm(x) > 0:
                x = rnd.normal(size=n)
                continue
            x = x / np.linalg.norm(x)
            product = d * x
            product[:-1] += e * x[1:]
            product[1:] += e * x[:-1]
            left = np.linalg.norm(product - (x @ product) * x)
            if turn >= 2 and (left <= 4 * tiny or left >= best / 2):
                break
            best = min(best, left)
        out[:, k] = x
    return out


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and unit vectors in columns."""
    n = len(matrix)
    scale = np.abs(matrix).max() if n else 0
    if not scale > 0 or count < 1:
        return np.zeros(0), np.zeros((n, 0))
    d, e, reflectors = tridiagonal(matrix / scale)
    values = leading_values(d, e, min(count, n))
    vectors = inverse_iteration(d, e, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return values * scale, vectors


# ---------------------------------------------------------------- the operator


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with the exact ``sums``; ``values`` and ``components`` (columns)
    of their covariance, of which ``trace`` is the whole variance; ``identity_error``: the
    largest entry of the whitened vectors' covariance less the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float
    scale: float

    @property
    def matrix(self) -> np.ndarray:
        """Centred whole numbers times this are whitened."""
        return self.components / np.sqrt(self.values)


def whole_numbers(vectors: DataFrame, id_col: str, x_col: str, scale: float) -> DataFrame:
    """(id, x array<bigint>) of the rows whose vectors are usable."""
    c = F.col(f"`{x_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), c.alias("c")).where(F.size("c") > 0).where(F.forall("c", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(TOO_LARGE / scale)), F.lit(False))))
    return rows.select("id", F.transform("c", lambda v: F.floor(v * F.lit(float(scale)))).alias("x"))


def _sums(batches):
    """(pos, s) of a task: exact sums of each place; place -1 has the number of vectors."""
    total, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = stack(batch, "x", len(batch.column("x")[0]))
        most = int(np.abs(x).max()) if x.size else 0
        own = x.sum(axis=0).tolist() if most * len(x) < 2**62 else x.astype(object).sum(axis=0).tolist()
        if total is not None and len(total) != len(own):
            raise ValueError("rows differ in their number of values")
        total = own if total is None else [a + b for a, b in zip(total, own)]
        count += len(x)
    if total is not None:
        places = pa.array([-1, *range(len(total))], pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array([Decimal(v) for v in (count, *total)], pa.decimal128(38, 0))], names=["pos", "s"])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with one rounding: the whole part of the mean comes off exactly."""
    whole = np.array([s // n for s in sums.tolist()], dtype=np.int64)
    rest = np.array([(s - w * n) / n for s, w in zip(sums.tolist(), whole.tolist())])
    return (x - whole).astype(float) - rest


def fit(vectors: DataFrame, id_col: str = "vec_id", x_col: str = "embedding", components: int = 4, scale: float = 256.0) -> Whitening:
    """Learn the whitening from every distinct usable vector."""
    distinct = materialize(whole_numbers(vectors, id_col, x_col, scale).select("x").distinct(), "whiten-vectors")
    rows = distinct.mapInArrow(_sums, "pos int, s decimal(38, 0)").groupBy("pos").agg(F.sum("s").alias("s"), F.count("s").alias("tasks")).collect()  # a row for each dimension
    found = {r["pos"]: int(r["s"]) for r in rows}
    if len({r["tasks"] for r in rows}) > 1:
        raise ValueError("vectors differ in their number of values")
    n, d = found.pop(-1, 0), len(found)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions: more than {MOST_DIMENSIONS}")
    sums = np.array([found[k] for k in range(d)], dtype=object)

    def covariance(width: int, shape):
        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    y = shape(_centred(stack(batch, "x", d), n, sums))
                    total = y.T @ y if total is None else total + y.T @ y
            return total

        out = tree_sum(distinct.mapInArrow(partial(run, width * width), ROW))
        return out.reshape(width, width) / n

    values, vectors_, error, trace = np.zeros(0), np.zeros((d, 0)), 0.0, 0.0
    if n > 1 and d:
        matrix = covariance(d, lambda y: y)
        trace = float(np.trace(matrix))
        values, vectors_ = leading_pairs((matrix + matrix.T) / 2, min(components, d))
        real = values > d * np.finfo(float).eps * values[0] if len(values) else np.zeros(0, bool)
        values, vectors_ = values[real], vectors_[:, real]
        if len(values):
            onto = vectors_ / np.sqrt(values)
            error = float(np.abs(covariance(len(values), lambda y: y @ onto) - np.eye(len(values))).max())
    discard(distinct)
    return Whitening(n, tuple(found[k] for k in range(d)), values, vectors_, trace, error, scale)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sums over places of (n x - sums)^2, exact; None beyond 64 bits."""
    most = n * int(np.abs(x).max() if x.size else 0) + max(map(abs, sums.tolist()), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        gap = n * x - sums.astype(np.int64)
        return (gap * gap).sum(axis=1).tolist()
    out = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [v if v < 2**63 else None for v in out]


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", x_col: str = "embedding") -> DataFrame:
    """(id, deviation, whitened array<double>) of every usable row."""
    rows = whole_numbers(vectors, id_col, x_col, model.scale)
    kind, d = dict(rows.dtypes)["id"], len(model.sums)
    n, sums, onto = model.n, np.array(model.sums, dtype=object), model.matrix
    k = onto.shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = stack(batch, "x", d)
                y = _centred(x, n, sums) @ onto
                arrays = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, np.ascontiguousarray(y).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_deviation(x, n, sums), pa.int64()), arrays], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind}, deviation bigint, whitened array<double>")


def components_of(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", x_col: str = "embedding") -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error) of every
    usable row and component."""
    share = [float(v / model.trace) for v in model.values]
    explained = F.array(*map(F.lit, share)) if share else F.array().cast("array<double>")
    return whiten(vectors, model, id_col, x_col).select("id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )

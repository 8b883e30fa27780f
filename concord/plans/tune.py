"""Choosing penalties: leave-one-out over a grid, and ridge regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from concord.model import Block, table_set
from concord.operators.align import aligned
from concord.operators.moments import ROW, SQL_LIMIT, aligned_stats, batches_of, gram, kernel, partial, stack, tree_sum
from concord.operators.prep import grid
from concord.plans.downdate import whole
from concord.plans.fit import DRIVER_LIMIT, _z, checked

#: From so many variables on the fits without one row are updates of the fit of all rows.
UPDATED = 24
#: Bytes of such fits that a pass over the rows broadcasts; more pairs of penalties take more passes.
PASS = 1 << 28


def default_grid(count: int = 5, low: float = 0.001, high: float = 1.0) -> list[float]:
    return np.linspace(low, high, count).tolist()


def ave_outer(g: np.ndarray, widths: list[int], lam: list[float], nfac: int) -> np.ndarray:
    """(fits, nfac): outer explained variance of complete-case fits, from the cross products
    (fits, P, P) of their centred variables; all fits are solved together."""
    starts = np.concatenate([[0], np.cumsum(widths)])
    w = np.zeros_like(g)
    for a, b, v in zip(starts, starts[1:], lam):
        try:
            lower = np.linalg.cholesky(g[:, a:b, a:b] + v * np.eye(b - a))
        except np.linalg.LinAlgError:
            raise ValueError("without one of the rows a table's cross-product matrix is not positive definite") from None
        w[:, a:b, a:b] = np.swapaxes(np.linalg.inv(lower), 1, 2)
    inner = np.swapaxes(w, 1, 2) @ g @ w
    values, vectors = np.linalg.eigh((inner + np.swapaxes(inner, 1, 2)) / 2)
    if nfac > g.shape[1] or (values[:, -nfac] <= 1e-10 * np.maximum(values[:, -1], 1e-300)).any():
        raise ValueError(f"there are fewer than {nfac} components")
    loadings = w @ vectors[:, :, ::-1][:, :, :nfac]  # of any length: correlations do not depend on it
    cov = g @ loadings
    spread = np.einsum("rij,rij->rj", loadings, cov)
    return (cov**2 / (np.einsum("rii->ri", g)[:, :, None] * spread[:, None, :])).sum(axis=1) / g.shape[1]


def leave_out(moments: np.ndarray, sums: np.ndarray, m: int, rows: np.ndarray) -> np.ndarray:
    """(rows, P, P): cross products of the z-scored variables without each of the rows: a
    rank-one change of the raw moments, scaled anew."""
    n = m - 1
    total = sums - rows
    centred = moments - rows[:, :, None] * rows[:, None, :] - total[:, :, None] * total[:, None, :] / n
    sd = np.sqrt(np.einsum("rii->ri", centred) / (n - 1))
    if not (sd > 0).all():
        raise ValueError("without one of the rows a variable is constant")
    return centred / (sd[:, :, None] * sd[:, None, :])


def leave_one_out_grid(x1: Block | DataFrame, x2: Block | DataFrame, grid1: list[float] | None = None, grid2: list[float] | None = None, nfac: int = 2, solver: str = "auto") -> tuple[tuple[float, float], DataFrame]:
    """The pair of penalties with the best mean outer explained variance over fits that leave
    out one individual each, and (lambda1, lambda2, mean_ave) of the whole grid. Both tables
    have the same individuals. Of equal pairs the first wins, lambda1 varying fastest.

    Each row needs only the moments of all rows and itself, so rows are scored in parallel.
    ``solver``: ``dense`` solves each row's problem, ``updates`` changes the fit of all rows by
    what the row takes away (and solves densely what that cannot prove); ``auto`` updates from
    ``UPDATED`` variables on. At most 4096 variables."""
    if solver not in ("auto", "dense", "updates"):
        raise ValueError("solver is auto, dense or updates")
    points = grid(grid1 or default_grid(), grid2 or default_grid())
    blocks = table_set({"x1": x1, "x2": x2} if isinstance(x1, Block) else [x1, x2])
    widths = [len(b.variables) for b in blocks.values()]
    p = sum(widths)
    if p > DRIVER_LIMIT:
        raise ValueError(f"more than {DRIVER_LIMIT} variables")
    raw = aligned(blocks, p > SQL_LIMIT or any(b.layout == "packed" for b in blocks.values()), keep_missing=True).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m, most, present, stats = aligned_stats(raw, widths, sql=p <= SQL_LIMIT)
        checked(blocks, dict(zip(blocks, stats)), True)
        if max(most) > 1:
            raise ValueError("a table has several rows of one id")
        if len(set(present)) > 1:
            raise ValueError("the tables differ in their rows: complete cases are required")
        if min(present) < m:
            raise ValueError("the tables describe different individuals: complete cases are required")
        # moments of z-scores: what is left out is small against them
        rows = _z(raw, np.repeat(np.arange(2), widths), np.concatenate([s["mean"] for s in stats]), np.concatenate([s["sd"] for s in stats]))
        moments = gram(rows, p)
        updates = 3 * nfac + 2 <= p and m > 2 and (solver == "updates" or (solver == "auto" and p >= UPDATED))
        some = max(1, PASS // (16 * p * p)) if updates else len(points)
        parts = [_left_out(rows, moments, widths, points[at : at + some], nfac, m, updates) for at in range(0, len(points), some)]
    finally:
        raw.unpersist()
    mean_ave = np.concatenate(parts)
    best = points[int(np.argmax(mean_ave))]
    frame = raw.sparkSession.createDataFrame([(a, b, float(v)) for (a, b), v in zip(points, mean_ave)], "lambda1 double, lambda2 double, mean_ave double")
    return best, frame


def _left_out(rows: DataFrame, moments: np.ndarray, widths: list[int], points: list[tuple[float, float]], nfac: int, m: int, updates: bool) -> np.ndarray:
    """The mean explained variance of each pair of penalties: one pass over z-scored rows."""
    p, spark = len(moments), rows.sparkSession
    shared = spark.sparkContext.broadcast((moments, [whole(moments, widths, list(point), nfac, m) if updates else None for point in points]))
    dense, step = max(1, (1 << 20) // (p * p)), max(1, (1 << 21) // (p * (3 * nfac + 2)))
    sums = np.zeros(p)

    def solved(x, point):
        g = shared.value[0]
        return sum(ave_outer(leave_out(g, sums, m, x[at : at + dense]), widths, list(point), nfac).mean(axis=1).sum() for at in range(0, len(x), dense))

    def score(batches):
        total = np.zeros(len(points) + 1)
        for batch in batches:
            whole_batch = stack(batch, "x", p)
            for at in range(0, len(whole_batch), step):
                x = whole_batch[at : at + step]
                for k, (point, fit) in enumerate(zip(points, shared.value[1])):
                    found, proven = fit.score(x) if fit else (np.zeros((len(x), 1)), np.zeros(len(x), bool))
                    total[k] += found[proven].mean(axis=1).sum() + solved(x[~proven], point)
                total[-1] += len(x)
        return total if total[-1] else None

    with batches_of(spark, max(1, (1 << 22) // p)):
        total = tree_sum(rows.select("x").mapInArrow(partial(score, 1), ROW))
    shared.unpersist()
    return total[:-1] / total[-1]


# ---------------------------------------------------------------- ridge


def ridge_inverse(matrix: np.ndarray | None = None, lam: float = 1.0, eigen: tuple[np.ndarray, np.ndarray] | None = None, one_is_none: bool = False) -> np.ndarray:
    """Q diag(1 / (l + lam)) Q' of a symmetric matrix, negative eigenvalues taken as 0.
    ``one_is_none``: a penalty of exactly 1 means none."""
    if matrix is None and eigen is None:
        raise ValueError("a matrix or its eigenvalues and vectors are needed")
    values, vectors = eigen if matrix is None else np.linalg.eigh(matrix)
    values = np.maximum(values, 0)
    weights = 1 / (values if one_is_none and lam == 1 else values + lam)
    return (vectors * weights) @ vectors.T


def _xy(frame: DataFrame, x: list[str], y: str) -> DataFrame:
    return frame.select(F.array(*(F.col(c).cast("double") for c in [*x, y])).alias("x"))


def ridge_solve(frame: DataFrame, x: list[str], y: str, lam: float) -> dict[str, float]:
    """Coefficients of y on x without intercept: the primal form of the dual solution."""
    g = gram(_xy(frame, x, y), len(x) + 1)
    coef = np.linalg.solve(g[:-1, :-1] + lam * np.eye(len(x)), g[:-1, -1])
    return dict(zip(x, coef.tolist()))


def ridge_looe(frame: DataFrame, x: list[str], y: str, lambdas: list[float] | None = None, nlambdas: int = 100, max_lambda: float = 1.0) -> tuple[float, DataFrame]:
    """The penalty with the least leave-one-out sum of squares, and (lambda, looe) of all.
    One pass gives the moments, a second all residuals e / (1 - h) for all penalties."""
    lambdas = list(lambdas) if lambdas is not None else default_grid(nlambdas, 0.001, max_lambda)
    rows, p = _xy(frame, x, y), len(x)
    g = gram(rows, p + 1)
    values, vectors = np.linalg.eigh(g[:-1, :-1])
    weight = 1 / (np.maximum(values, 0)[:, None] + np.array(lambdas)[None, :])
    right = vectors.T @ g[:-1, -1]

    def residuals(batches):
        total = np.zeros(len(lambdas))
        for batch in batches:
            data = stack(batch, "x", p + 1)
            z = data[:, :-1] @ vectors
            e = data[:, -1:] - z @ (weight * right[:, None])
            total += ((e / (1 - (z * z) @ weight)) ** 2).sum(axis=0)
        return total

    looe = tree_sum(rows.mapInArrow(partial(residuals, p), ROW))
    looe = np.zeros(len(lambdas)) if looe is None else looe
    out = frame.sparkSession.createDataFrame([(float(v), float(e)) for v, e in zip(lambdas, looe)], "lambda double, looe double")
    return float(lambdas[int(np.argmin(looe))]), out


def ridge_looe_inverse(frame: DataFrame, x: list[str], y: str, lambdas: list[float] | None = None, **grid_options) -> tuple[float, np.ndarray, DataFrame]:
    """As :func:`ridge_looe`, and the inverse of the penalized cross products at the best penalty:
    variables x variables, which holds what the inverse over individuals would."""
    best, found = ridge_looe(frame, x, y, lambdas, **grid_options)
    return best, ridge_inverse(gram(_xy(frame, x, y), len(x) + 1)[:-1, :-1], best), found


def kernel_looe(values: DataFrame, y: DataFrame, lambdas: list[float] | None = None, nlambdas: int = 100, max_lambda: float = 1.0) -> tuple[float, DataFrame, np.ndarray, list[str]]:
    """Leave-one-out of ridge regression where features outnumber samples. ``values``: (feature,
    sample, value), missing cells are 0; ``y``: (sample, value). The kernel of samples is
    summed over features in Spark and taken apart once; with G = (kernel + lambda)^-1 sample i
    is missed by (G y)_i / G_ii. Returns the best penalty, (lambda, looe) of all, G at the best
    one, and the samples in its order. At most 4096 samples."""
    lambdas = list(lambdas) if lambdas is not None else default_grid(nlambdas, 0.001, max_lambda)
    found = y.select(F.col("sample").cast("string").alias("sample"), F.col("value").cast("double").alias("value")).limit(DRIVER_LIMIT + 1).collect()
    if len(found) > DRIVER_LIMIT:
        raise ValueError(f"more than {DRIVER_LIMIT} samples")
    known = {r["sample"]: r["value"] for r in found}
    if len(known) < len(found) or None in known.values():
        raise ValueError("each sample needs one value")
    samples = sorted(known)
    target = np.array([known[s] for s in samples])
    k = kernel(values.select(F.col("feature").cast("string").alias("feature"), F.col("sample").cast("string").alias("sample"), F.col("value").cast("double").alias("value")), samples)
    eigen, vectors = np.linalg.eigh(k)
    weight = 1 / (np.maximum(eigen, 0)[:, None] + np.array(lambdas)[None, :])
    missed = (vectors @ (weight * (vectors.T @ target)[:, None])) / ((vectors**2) @ weight)
    looe = (missed**2).sum(axis=0)
    best = float(lambdas[int(np.argmin(looe))])
    frame = values.sparkSession.createDataFrame([(float(v), float(e)) for v, e in zip(lambdas, looe)], "lambda double, looe double")
    return best, frame, ridge_inverse(lam=best, eigen=(eigen, vectors)), samples

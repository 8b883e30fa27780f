"""Fits of more variables than the driver can decompose.

Three things of the size of variables x variables never meet in one process: the tables' own
cross products and the inverses of their Cholesky factors are tiles in the shared folder, and
the matrix whose eigenvectors are wanted is only ever multiplied with a few vectors. A
product is three passes: over tiles of the factors, over the aligned rows, and over the tiles
again. Block Lanczos with full reorthogonalisation turns products into the leading pairs; the
driver holds variables x (vectors of the basis).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concord.operators.moments import ROW, batches_of, partial, stack, tree_sum
from concord.operators.tiles import TILE, apply, inverse_factor, product_tiles
from concord.plans.solve import Solution, cholesky, sign_of
from concord.sources.paths import discard, materialize

#: Bytes of values in a block of rows.
BLOCK_BYTES = 1 << 20
#: Blocks, or tiles, of an Arrow batch.
BATCH = 8
#: Vectors that the basis holds before it starts again from its best.
BASIS = 320


def row_blocks(raw: DataFrame, count: int, width: int) -> DataFrame:
    """Aligned rows as blocks (ids, present, x): ids of the rows, how many rows each table has of
    them, and all values, row by row, NaN for null. Written once, read by every pass."""
    step = max(1, BLOCK_BYTES // (8 * width))
    spark = raw.sparkSession

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                there = np.stack([part.column(f"n{k}").to_numpy() for k in range(count)], axis=1).astype(np.int32)
                x = stack(part, "x", width).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.string())), pa.array([there.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "present", "x"])

    with batches_of(spark, step):
        return materialize(raw.select("id", "x", *(f"n{k}" for k in range(count))).mapInArrow(run, "ids array<string>, present binary, x binary"), "fit-rows")


def unpacked(count: int, width: int) -> Callable:
    """batch -> (counts of rows x tables, raw values) of each block in it."""

    def read(batch):
        for present, x in zip(batch.column("present"), batch.column("x")):
            yield np.frombuffer(present.as_buffer(), dtype=np.int32).reshape(-1, count), np.frombuffer(x.as_buffer()).reshape(-1, width)

    return read


class Rows:
    """Passes over blocks of rows, whose values become z-scores (0 where absent) on the way."""

    def __init__(self, blocks: DataFrame, widths: list[int], mean: np.ndarray, sd: np.ndarray, keep: np.ndarray | None = None):
        """``keep``: which variables of the blocks take part; the other arguments are theirs."""
        self.blocks, self.widths, self.mean, self.sd, self.keep = blocks, widths, mean, sd, keep
        self.of = np.repeat(np.arange(len(widths)), widths)

    def reader(self) -> Callable:
        """batch -> (ids, present rows x tables, X rows x variables) of each block in it."""
        of, mean, sd, keep = self.of, self.mean, self.sd, self.keep
        parts = unpacked(len(self.widths), len(of) if keep is None else len(keep))
        chosen = None if keep is None or keep.all() else np.flatnonzero(keep)

        def read(batch):
            for ids, (counts, x) in zip(batch.column("ids"), parts(batch)):
                there = counts > 0
                z = x - mean if chosen is None else x[:, chosen] - mean
                z /= sd
                if not there.all():
                    z *= there[:, of]
                yield ids, there, z

        return read

    def summed(self, function: Callable, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``function(present, X)`` over all blocks."""
        read = self.reader()

        def run(batches):
            total = None
            for batch in batches:
                for _, there, z in read(batch):
                    own = function(there, z)
                    total = own if total is None else total + own
            return total

        with batches_of(self.blocks.sparkSession, BATCH):
            total = tree_sum(self.blocks.select("ids", "present", "x").mapInArrow(partial(run, 0), ROW))
        return np.zeros(shape) if total is None else total.reshape(shape)

    def cross(self, vectors: np.ndarray) -> np.ndarray:
        """Xc' Ksum^-1 Xc times the vectors."""
        return self.summed(lambda there, z: z.T @ ((z @ vectors) / there.sum(axis=1)[:, None]), vectors.shape)

    def project(self, matrix: np.ndarray, names: list[str], over_ksum: bool = True) -> DataFrame:
        """(id, n0, n1, ..., <names>): X times the matrix, over the number of tables if asked."""
        read, count = self.reader(), len(self.widths)

        def run(batches):
            for batch in batches:
                for ids, there, z in read(batch):
                    y = z @ matrix / (there.sum(axis=1)[:, None] if over_ksum else 1.0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.string()), *(pa.array(there[:, k].astype(np.int32)) for k in range(count)), *(pa.array(np.ascontiguousarray(y[:, c])) for c in range(len(names)))], names=["id", *(f"n{k}" for k in range(count)), *names])

        return self.blocks.select("ids", "present", "x").mapInArrow(run, ", ".join(["id string", *(f"n{k} int" for k in range(count)), *(f"{n} double" for n in names)]))


def lanczos(product: Callable, width: int, wanted: int, tol: float = 1e-10, block: int | None = None, basis: int = BASIS, most: int = 400, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues, unit vectors, and the number of products taken of a
    symmetric non-negative matrix that is known by ``product(vectors)``. Every new block is
    made orthogonal to all before it, twice. A basis of ``basis`` vectors starts again from
    its best ones. ``ValueError`` if ``most`` products do not bring residuals below ``tol``
    of the largest eigenvalue."""
    block = min(width, block or wanted + 14)  # a pass costs about the same for a few vectors more
    basis = max(basis, wanted + 3 * block)
    rnd = np.random.default_rng(seed)
    q = np.zeros((width, 0))
    aq = np.zeros((width, 0))
    fresh = rnd.normal(size=(width, block))
    for taken in range(1, most + 1):
        fresh = _orthogonal(fresh, q, rnd, width)
        if fresh.shape[1]:
            q, aq = np.hstack([q, fresh]), np.hstack([aq, product(fresh)])
        h = q.T @ aq
        values, turned = np.linalg.eigh((h + h.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        k = min(wanted, len(values))
        vectors = q @ turned[:, :k]
        left = aq @ turned[:, :k] - vectors * values[:k]
        size = np.linalg.norm(left, axis=0)
        if q.shape[1] == width or not fresh.shape[1] or (len(values) >= wanted and (size <= tol * max(abs(values[0]), 1e-300)).all()):
            return values[:k], vectors, taken
        new = aq[:, -fresh.shape[1] :]
        if q.shape[1] + block > basis:  # the best of the basis, and what they lack
            keep = min(wanted + block, q.shape[1])
            more = aq @ turned[:, :keep] - (q @ turned[:, :keep]) * values[:keep]
            q, aq = q @ turned[:, :keep], aq @ turned[:, :keep]
            new = more[:, :block]
        fresh = new
    raise ValueError(f"the components did not settle in {most} products: the largest residual is {size.max():.1e}")


def _orthogonal(fresh: np.ndarray, q: np.ndarray, rnd, width: int) -> np.ndarray:
    """An orthonormal basis of what ``fresh`` adds to ``q``; directions that add nothing but
    rounding are replaced by random ones while there is room."""
    scale = np.linalg.norm(fresh, axis=0)
    fresh = fresh / np.where(scale > 0, scale, 1.0)
    for _ in range(3):
        fresh = fresh - q @ (q.T @ fresh)
        size = np.linalg.norm(fresh, axis=0)
        lost = size < 1e-12
        fresh[:, lost] = rnd.normal(size=(width, int(lost.sum())))
        fresh /= np.linalg.norm(fresh, axis=0)
    room = width - q.shape[1]
    fresh = fresh[:, :room]
    if not fresh.shape[1]:
        return fresh
    fresh = np.linalg.qr(fresh - q @ (q.T @ fresh))[0]
    fresh = fresh - q @ (q.T @ fresh)
    return np.linalg.qr(fresh)[0]


def _applied(spark, factor: DataFrame, widths: list[int], vectors: np.ndarray, transpose: bool, tile: int) -> np.ndarray:
    with batches_of(spark, BATCH):
        return apply(factor, widths, vectors, transpose, tile)


def solve_large(rows: Rows, sums: np.ndarray, squares: np.ndarray, names: list[str], lam: list[float], nfac: int, m: int, unit: bool, scores: bool, tile: int = TILE) -> tuple[Solution, np.ndarray]:
    """As :func:`concord.plans.solve.solve`, and the cross products of all variables with the
    components; weights only if ``scores`` are asked for."""
    widths, n = rows.widths, len(rows.widths)
    read = rows.reader()

    def matrices(batch):
        return (z for _, _, z in read(batch))

    spark = rows.blocks.sparkSession
    with batches_of(spark, BATCH):
        products = product_tiles(rows.blocks.select("ids", "present", "x"), widths, matrices, tile)
    starts = np.concatenate([[0], np.cumsum(widths)])

    def lower(x, t, k):
        first = starts[t] + k * tile
        return cholesky(x, names[t], squares[first : first + len(x)] + lam[t])

    with batches_of(spark, BATCH):
        factor = inverse_factor(products, widths, lam, lower, tile)
    times = lambda v, transpose: _applied(spark, factor, widths, v, transpose, tile)
    try:

        def product(v):
            return times(rows.cross(times(v, True)), False)

        values, vectors, _ = lanczos(product, sum(widths), nfac)
        if len(values) < nfac or values[nfac - 1] <= 1e-10 * max(values[0], 1e-300):
            raise ValueError(f"there are fewer than {nfac} components")
        loadings = np.sqrt(n) * times(vectors, True) / np.sqrt(values)
        crossed = rows.cross(loadings)
        sign = sign_of(crossed)
        loadings, crossed = loadings * sign, crossed * sign
        weights: list[np.ndarray] = []
        if scores:
            raw = times(times(crossed, False), True)
            parts = [slice(a, b) for a, b in zip(starts, starts[1:])]
            spread = rows.summed(lambda there, z: np.stack([((z[:, p] @ raw[p]) ** 2).sum(axis=0) for p in parts]), (n, nfac))
            for k, p in enumerate(parts):
                mean = sums[p] @ raw[p] / m
                weights.append(raw[p] / np.sqrt(np.maximum((spread[k] - m * mean**2) / (m - 1), 0)))
    finally:
        discard(factor)
    return Solution(values * n if unit else values, loadings, weights), crossed

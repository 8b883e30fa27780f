"""Matrices too large for one process, as tiles.

A symmetric matrix is rows (t, i, j, data) with i >= j: tile (i, j) of the matrix of table t,
``tile`` x ``tile`` numbers (fewer at the edge), row by row. Sums of products are taken over
rows of data in passes of bounded memory and added up in a tree; the Cholesky factorisation
goes through block columns from the left, each of which updates what is right of and below it
by products of tiles that meet in a shuffle. No task and not the driver holds more than a few
tiles, and what is written between steps lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.moments import ROW, partial, tree_sum
from concord.sources.paths import discard, materialize, shared_path

TILE = 512
#: Bytes of tiles that a task adds up in one pass over the rows.
PASS_BYTES = 256 << 20
#: Most tasks that take part in a pass: each gives as many partial tiles as the pass has.
PASS_TASKS = 64
FAN_IN = 16
SCHEMA = "t int, i int, j int, data binary"


def cuts(width: int, tile: int) -> list[tuple[int, int]]:
    """First and last column of each block of columns."""
    return [(a, min(width, a + tile)) for a in range(0, width, tile)]


def _tile(data, rows: int) -> np.ndarray:
    return np.frombuffer(data).reshape(rows, -1)


def _batch(rows: list[tuple], names: tuple[str, ...] = ("t", "i", "j", "data")) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in c], pa.binary()) if n == "data" else pa.array(c, pa.string() if n == "kind" else pa.int32()) for n, c in zip(names, columns)], names=list(names))


def product_tiles(rows: DataFrame, widths: list[int], matrices: Callable, tile: int = TILE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Tiles of X_t' X_t for each table t. ``matrices(batch)`` makes parts of X, all tables
    side by side, of a batch of ``rows``. Each pass over the rows takes as many tiles as fit ``pass_bytes``."""
    starts = np.concatenate([[0], np.cumsum(widths)]).tolist()
    blocks = {t: [(starts[t] + a, starts[t] + b) for a, b in cuts(w, tile)] for t, w in enumerate(widths)}
    wanted = [(t, i, j) for t, own in blocks.items() for i in range(len(own)) for j in range(i + 1)]
    each = max(1, pass_bytes // (8 * tile * tile))
    parts = rows.rdd.getNumPartitions()
    tasks = min(parts, PASS_TASKS)
    thin = rows.coalesce(tasks) if tasks < parts else rows
    out = None
    for at in range(0, len(wanted), each):
        chosen = wanted[at : at + each]

        def run(batches, chosen=chosen):
            total: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                for x in matrices(batch):
                    for t, i, j in chosen:
                        (a, b), (c, d) = blocks[t][i], blocks[t][j]
                        own = x[:, a:b].T @ x[:, c:d]
                        if (t, i, j) in total:
                            total[t, i, j] += own
                        else:
                            total[t, i, j] = own
            task = TaskContext.get().partitionId()
            for key, data in total.items():
                yield _batch([(*key, task, data)], ("t", "i", "j", "task", "data"))

        part = _added(thin.mapInArrow(run, "t int, i int, j int, task int, data binary"), tasks)
        out = part if out is None else out.unionByName(part)
    return materialize(out, "tiles-products", "none")


def _added(parts: DataFrame, tasks: int) -> DataFrame:
    """One tile for each key, partial ones added ``FAN_IN`` at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for data in table.column("data"):
            own = np.frombuffer(data.as_buffer())
            total = own.copy() if total is None else np.add(total, own, out=total)
        head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("t", "i", "j")]
        return pa.Table.from_arrays([*head, pa.array([table.column("task")[0].as_py() // FAN_IN], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["t", "i", "j", "task", "data"])

    while tasks > 1:
        parts = parts.groupBy("t", "i", "j", F.floor(F.col("task") / FAN_IN).alias("group")).applyInArrow(lambda table: add(table), "t int, i int, j int, task int, data binary")
        tasks = -(-tasks // FAN_IN)
    return parts.drop("task")


def inverse_factor(products: DataFrame, widths: list[int], lam: list[float], lower: Callable, tile: int = TILE) -> DataFrame:
    """Tiles, i >= j, of L^-1 where L L' = X' X + lam for each table.

    Right-looking: step k factors the diagonal tile, scales the block column below it, and
    takes its products off all tiles to the right; the same elimination, applied to the
    identity, leaves row k of the inverse. ``lower(matrix, t, k)`` factors what is left of
    tile k of the diagonal and raises if table t has no factor. Tiles of the diagonal, one for each table, are all that
    the driver sees. ``products`` is given up."""
    counts = [len(cuts(w, tile)) for w in widths]
    spark = products.sparkSession
    path = shared_path(spark, "tiles-factor")
    sizes = [[b - a for a, b in cuts(w, tile)] for w in widths]

    def penalized(batches):
        for batch in batches:
            for t, i, j, data in zip(*(batch.column(c).to_pylist() for c in ("t", "i", "j", "data"))):
                x = _tile(data, sizes[t][i]).copy()
                if i == j:
                    x[np.diag_indices(len(x))] += lam[t]
                yield _batch([("a", t, i, j, x)], KIND)

    state, written = products.mapInArrow(penalized, f"kind string, {SCHEMA}"), [products]
    for k in range(max(counts)):
        diagonal = state.where((F.col("kind") == "a") & (F.col("i") == k) & (F.col("j") == k)).collect()  # a tile for each table
        pivots = {r["t"]: np.linalg.inv(lower(_tile(r["data"], sizes[r["t"]][k]), r["t"], k)) for r in diagonal}
        spread, row = _step(k, pivots, sizes, counts)
        own = spark.createDataFrame([(t, k, k, bytearray(x.tobytes())) for t, x in pivots.items()], SCHEMA)
        state.where((F.col("kind") == "r") & (F.col("i") == k)).mapInArrow(row, SCHEMA).unionByName(own).write.mode("append").option("compression", "none").parquet(path)
        if k + 1 < max(counts):
            met = state.where(F.col("i") >= k).mapInArrow(spread, f"kind string, t int, i int, j int, role int, data binary")
            left = met.groupBy("kind", "t", "i", "j").applyInArrow(_updated(sizes), f"kind string, {SCHEMA}")
            state = materialize(left, "tiles-left", "none")
            discard(*written)
            written = [state]
    discard(*written)
    out = spark.read.schema(SCHEMA).parquet(path)
    out.shared_folder = path
    return out


KIND = ("kind", "t", "i", "j", "data")


def _step(k: int, pivots: dict, sizes: list, counts: list):
    """Of step k: what sends tiles to those that they change, and what finishes row k of the inverse."""

    def row(batches):  # M_kj = L_kk^-1 R_kj
        for batch in batches:
            for t, j, data in zip(*(batch.column(c).to_pylist() for c in ("t", "j", "data"))):
                yield _batch([(t, k, j, pivots[t] @ _tile(data, sizes[t][k]))])

    def spread(batches):
        names = ("kind", "t", "i", "j", "role", "data")
        for batch in batches:
            for kind, t, i, j, data in zip(*(batch.column(c).to_pylist() for c in KIND)):
                x = _tile(data, sizes[t][i])
                if kind == "a" and i > k and j == k:  # L_ik, the left factor of row i and the right one of column i
                    panel = x @ pivots[t].T
                    for c in range(k + 1, i + 1):
                        yield _batch([("a", t, i, c, 1, panel)], names)
                    for r in range(i, counts[t]):
                        yield _batch([("a", t, r, i, 2, panel)], names)
                    for c in range(k + 1):
                        yield _batch([("r", t, i, c, 1, panel)], names)
                elif kind == "a" and i == k and j == k:  # M_kk
                    for r in range(k + 1, counts[t]):
                        yield _batch([("r", t, r, k, 2, pivots[t])], names)
                elif kind == "r" and i == k:  # M_kj
                    done = pivots[t] @ x
                    for r in range(k + 1, counts[t]):
                        yield _batch([("r", t, r, j, 2, done)], names)
                elif i > k and (kind == "r" or j > k):
                    yield _batch([(kind, t, i, j, 0, x)], names)

    return spread, row


def _updated(sizes: list):
    def update(table: pa.Table) -> pa.Table:
        kind, t, i, j = (table.column(c)[0].as_py() for c in ("kind", "t", "i", "j"))
        found = {r: d for r, d in zip(table.column("role").to_pylist(), table.column("data").to_pylist())}
        left, right = (np.frombuffer(found[r]) for r in (1, 2))
        left = left.reshape(sizes[t][i], -1)
        if kind == "a":  # A_ij - L_ik L_jk'
            change = left @ right.reshape(sizes[t][j], -1).T
        else:  # R_ij - L_ik M_kj
            change = left @ right.reshape(left.shape[1], -1)
        out = (np.frombuffer(found[0]).reshape(change.shape) if 0 in found else 0.0) - change
        return pa.Table.from_batches([_batch([(kind, t, i, j, out)], KIND)])

    return update


def apply(tiles: DataFrame, widths: list[int], vectors: np.ndarray, transpose: bool = False, tile: int = TILE) -> np.ndarray:
    """L^-1 times the vectors of all tables (or its transpose), from lower tiles; one pass over
    the tiles without a shuffle. As many numbers as ``vectors`` has come back from a task."""
    starts = np.concatenate([[0], np.cumsum(widths)]).tolist()
    blocks = [[(starts[t] + a, starts[t] + b) for a, b in cuts(w, tile)] for t, w in enumerate(widths)]

    def run(batches):
        total = None
        for batch in batches:
            for t, i, j, data in zip(*(batch.column(c).to_pylist() for c in ("t", "i", "j", "data"))):
                (a, b), (c, d) = blocks[t][i], blocks[t][j]
                if total is None:
                    total = np.zeros(vectors.shape)
                x = _tile(data, b - a)
                if transpose:
                    total[c:d] += x.T @ vectors[a:b]
                else:
                    total[a:b] += x @ vectors[c:d]
        return total

    total = tree_sum(tiles.mapInArrow(partial(run, 0), ROW))
    return np.zeros(vectors.shape) if total is None else total.reshape(vectors.shape)

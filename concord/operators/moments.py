"""Sums over rows: column statistics, Gram matrices, kernels."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.model import WIDE, Block

#: Up to this many variables the sums are SQL aggregates; beyond, numpy on Arrow batches.
SQL_LIMIT = 24
ROW = "task int, data binary"


@contextmanager
def batches_of(spark, rows: int):
    """Within it Arrow batches have at most so many rows: for rows of many numbers, of which the
    usual ten thousand would not fit a worker. Only for jobs that run within it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stack(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """Rows x width of an array column without nulls."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(values) * width:
        raise ValueError("rows differ in their number of values")
    return flat.reshape(-1, width)


def tree_sum(partials: DataFrame, fan_in: int = 16, merge=np.add) -> np.ndarray | None:
    """Add up rows (task, data: doubles of one length) in rounds of ``fan_in`` rows a task,
    so that neither a task nor the driver gathers the matrices of all tasks. Each round is a
    shuffle: without one, what makes the rows would run in as few tasks as add them. ``merge``:
    what makes one array of two, in any order, in place of the sum."""

    def add(batches):
        total = None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                part = np.frombuffer(data)
                total = part.copy() if total is None else merge(total, part)
        task = TaskContext.get().partitionId()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["task", "data"])

    parts = partials.rdd.getNumPartitions()
    while parts > 1:
        parts = 1 if parts <= fan_in else -(-parts // fan_in)
        partials = partials.repartition(parts, "task").mapInArrow(add, ROW)
    total = None
    for row in partials.toLocalIterator():
        part = np.frombuffer(row["data"])
        total = part.copy() if total is None else merge(total, part)
    return total


def partial(function, width: int):
    """Wrap ``function(batches) -> array`` as a mapInArrow function that gives one row a task."""

    def run(batches):
        total = function(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.ascontiguousarray(total, dtype=float).tobytes()], pa.binary())], names=["task", "data"])

    return run


def _stats(table: Block) -> np.ndarray:
    """Row count, then missing, mean and sum of squared deviations of each variable."""
    p = len(table.variables)
    if table.layout == "wide" and p <= WIDE:
        columns = [F.col(f"v{k}") for k in range(p)]
        aggs = [F.count(F.lit(1)), *(F.count_if(c.isNull() | F.isnan(c)) for c in columns), *(F.avg(c) for c in columns), *(F.var_pop(c) * F.count(c) for c in columns)]
        row = table.doubles().agg(F.array(*(a.cast("double") for a in aggs)).alias("v")).first()
        return np.array([np.nan if x is None else x for x in row["v"]])

    def sums(batches):
        n, bad, mean, m2 = 0, np.zeros(p), np.zeros(p), np.zeros(p)
        for batch in batches:
            if batch.column("x").null_count:
                raise ValueError("a row without values")
            rows = stack(batch, "x", p).astype(float)
            if len(rows):
                own = rows.mean(axis=0)
                bad += np.isnan(rows).sum(axis=0)
                n, mean, m2 = _joined(n, mean, m2, len(rows), own, ((rows - own) ** 2).sum(axis=0))
        return np.concatenate([[n], bad, mean, m2]) if n else None

    def merge(a, b):
        n, mean, m2 = _joined(a[0], a[1 + p : 1 + 2 * p], a[1 + 2 * p :], b[0], b[1 + p : 1 + 2 * p], b[1 + 2 * p :])
        return np.concatenate([[n], a[1 : 1 + p] + b[1 : 1 + p], mean, m2])

    total = tree_sum(table.arrays().mapInArrow(partial(sums, p), ROW), merge=merge)
    return np.zeros(1 + 3 * p) if total is None else total


def _joined(n: int, mean, m2, k: int, own, own2):
    """Counts, means and squared deviations of two parts together: parts about their own
    means lose no digits."""
    delta = own - mean
    return n + k, mean + delta * k / (n + k), m2 + own2 + delta**2 * n * k / (n + k)


def all_column_stats(tables: dict[str, Block]) -> dict[str, dict]:
    """For each table: rows, mean and sample deviation of each variable, and how many of its
    values are null or NaN. What tasks find is merged in a tree."""
    out = {}
    for name, table in tables.items():
        p, v = len(table.variables), _stats(table)
        n = int(v[0])
        mean, m2 = (v[1 + p : 1 + 2 * p], v[1 + 2 * p :]) if n else (np.zeros(p), np.zeros(p))
        out[name] = {"n": n, "mean": mean, "sd": np.sqrt(m2 / (n - 1)) if n > 1 else np.full(p, np.nan), "bad": v[1 : 1 + p].astype(int)}
    return out


def aligned_stats(rows: DataFrame, widths: list[int], sql: bool, read=None) -> tuple[int, list[int], list[int], list[dict]]:
    """From aligned rows whose missing values are null, in one job: individuals, the most rows
    of an id in each table, individuals of each table, and each table's statistics. ``read``:
    batch -> (counts of rows x tables, values) of its parts, where they are kept otherwise."""
    count, p = len(widths), sum(widths)
    of = np.repeat(np.arange(count), widths)
    if sql:
        x = [F.when(F.col(f"n{of[j]}") > 0, F.col("x")[j]) for j in range(p)]
        bad = [F.count_if((F.col(f"n{of[j]}") > 0) & (F.col("x")[j].isNull() | F.isnan(F.col("x")[j]))) for j in range(p)]
        head = [F.count(F.lit(1)), *(F.max(f"n{k}") for k in range(count)), *(F.count_if(F.col(f"n{k}") > 0) for k in range(count))]
        parts = np.array([np.nan if v is None else v for v in rows.agg(*head, *bad, *(F.avg(c) for c in x), *(F.var_pop(c) * F.count(c) for c in x)).first()], dtype=float)
    else:

        def merged(a, b):
            """Two tasks' (m, most, n, bad, mean, m2)."""
            n, k = (v[1 + count : 1 + 2 * count][of] for v in (a, b))
            (bad, mean, m2), (bad2, mean2, m22) = (np.split(v[1 + 2 * count :], 3) for v in (a, b))
            both = np.maximum(n + k, 1)
            delta = mean2 - mean
            head = [a[:1] + b[:1], np.maximum(a[1 : 1 + count], b[1 : 1 + count]), a[1 + count : 1 + 2 * count] + b[1 + count : 1 + 2 * count]]
            return np.concatenate([*head, bad + bad2, mean + delta * k / both, m2 + m22 + delta**2 * n * k / both])

        def columns(batch):
            yield np.stack([batch.column(f"n{k}").to_numpy() for k in range(count)], axis=1), stack(batch, "x", p).astype(float)

        def sums(batches):
            m, most, n, bad, mean, m2 = 0, np.zeros(count), np.zeros(count), np.zeros(p), np.zeros(p), np.zeros(p)
            for counts, values in (part for batch in batches if batch.num_rows for part in (read or columns)(batch)):
                flags = counts.T
                m, most = m + len(values), np.maximum(most, flags.max(axis=1))
                for k in range(count):
                    here, own = of == k, values[flags[k] > 0][:, of == k]
                    if len(own):
                        bad[here] += np.isnan(own).sum(axis=0)
                        center = own.mean(axis=0)
                        n[k], mean[here], m2[here] = _joined(n[k], mean[here], m2[here], len(own), center, ((own - center) ** 2).sum(axis=0))
            return np.concatenate([[m], most, n, bad, mean, m2]) if m else None

        chosen = rows if read else rows.select("x", *(f"n{k}" for k in range(count)))
        parts = tree_sum(chosen.mapInArrow(partial(sums, p), ROW), merge=merged)
        if parts is None:
            parts = np.zeros(1 + 2 * count + 3 * p)
    m, most, present = int(parts[0]), np.nan_to_num(parts[1 : 1 + count]), np.nan_to_num(parts[1 + count : 1 + 2 * count])
    bad, mean, m2 = (v.copy() for v in np.split(parts[1 + 2 * count :], 3))
    absent = present[of] == 0
    bad[absent], mean[absent], m2[absent] = 0, 0, 0
    stats = []
    for k in range(count):
        here, n = of == k, int(present[k])
        stats.append({"n": n, "mean": mean[here], "sd": np.sqrt(m2[here] / (n - 1)) if n > 1 else np.full(widths[k], np.nan), "bad": bad[here].astype(int)})
    return m, [int(v) for v in most], [int(v) for v in present], stats


def column_stats(table: Block) -> dict:
    return all_column_stats({"": table})[""]


def grams(frame: DataFrame, width: int, x_col: str = "x", weights: tuple[str | None, ...] = (None,)) -> list[np.ndarray]:
    """For each weight the sum over rows of weight * x x', all in one pass. Small ones are SQL
    sums over the upper triangle; others are products of Arrow batches, added up in a tree."""
    columns = [(F.lit(1.0) if w is None else F.expr(w)).cast("double").alias(f"w{n}") for n, w in enumerate(weights)]
    if width <= SQL_LIMIT:
        pairs = [(a, b) for a in range(width) for b in range(a, width)]
        cells = frame.select(*columns, *(F.col(x_col)[k].alias(f"x{k}") for k in range(width)))
        product = lambda n, a, b: F.col(f"x{a}") * F.col(f"x{b}") if weights[n] is None else F.col(f"w{n}") * F.col(f"x{a}") * F.col(f"x{b}")
        row = cells.agg(*(F.sum(product(n, a, b)) for n in range(len(weights)) for a, b in pairs)).first()
        out = np.zeros((len(weights), width, width))
        for (n, a, b), v in zip(((n, a, b) for n in range(len(weights)) for a, b in pairs), row):
            out[n, a, b] = out[n, b, a] = v or 0.0
        return list(out)

    def products(batches):
        total = np.zeros((len(weights), width, width))
        for batch in batches:
            x = stack(batch, "x", width)
            for n, w in enumerate(weights):
                total[n] += x.T @ x if w is None else (x * batch.column(f"w{n}").to_numpy()[:, None]).T @ x
        return total

    total = tree_sum(frame.select(F.col(x_col).alias("x"), *columns).mapInArrow(partial(products, width), ROW))
    return list(np.zeros((len(weights), width, width)) if total is None else total.reshape(len(weights), width, width))


def column_sums(frame: DataFrame, width: int, x_col: str = "x") -> np.ndarray:
    """Sums of each place of an array column, in a tree."""

    def run(batches):
        total = None
        for batch in batches:
            own = stack(batch, "x", width).sum(axis=0)
            total = own if total is None else total + own
        return total

    total = tree_sum(frame.select(F.col(x_col).alias("x")).mapInArrow(partial(run, width), ROW))
    return np.zeros(width) if total is None else total


def gram(frame: DataFrame, width: int, x_col: str = "x", weight: str | None = None) -> np.ndarray:
    """sum over rows of weight * x x'."""
    return grams(frame, width, x_col, (weight,))[0]


def diagonal_scaled(frame: DataFrame, columns: list[str], left: str | None = None, right: list[float] | None = None) -> DataFrame:
    """Rows times the column ``left`` and columns times the numbers ``right``: products with
    diagonal matrices, which are never formed."""
    out = []
    for n, c in enumerate(columns):
        value = F.col(f"`{c}`").cast("double")
        value = value if left is None else value * F.col(f"`{left}`")
        out.append((value if right is None else value * F.lit(float(right[n]))).alias(c))
    return frame.select(*(F.col(f"`{c}`") for c in frame.columns if c not in columns), *out)


def scattered(cells: DataFrame, key: str, width: int, fill: float | None, x_col: str = "x") -> DataFrame:
    """(key, x) of (key, pos, value): each key's values in an array of ``width``, ``fill``
    elsewhere. Values go to their places in Arrow batches, in time linear in the cells."""
    kind = dict(cells.dtypes)[key]
    grouped = cells.groupBy(key).agg(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"))).alias("cells"))
    base = np.nan if fill is None else fill

    def run(batches):
        for batch in batches:
            lists = batch.column("cells")
            flat = lists.flatten()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            pos, value = flat.field("pos").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, step):
                rows = min(step, batch.num_rows - at)
                own, mine = np.repeat(np.arange(rows), np.diff(ends[at : at + rows + 1])), slice(ends[at], ends[at + rows])
                out = np.full((rows, width), base)
                out[own, pos[mine]] = value[mine]
                items = pa.array(out.ravel(), pa.float64(), from_pandas=fill is None)  # NaN stands for null
                arrays = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, items)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, rows), arrays], names=[key, x_col])

    step = max(1, (1 << 19) // max(1, width))
    return grouped.mapInArrow(run, f"`{key}` {kind}, {x_col} array<double>")


def placed(values: DataFrame, column: str, names: list[str]) -> DataFrame:
    """``values`` with ``pos``, the place of their ``column`` in ``names``; others are left out.
    The table of places is sent along only where it is short."""
    places = values.sparkSession.createDataFrame(list(enumerate(names)), f"pos int, `{column}` string")
    return values.join(F.broadcast(places) if len(names) <= 50_000 else places, column)


def kernel(values: DataFrame, samples: list[str]) -> np.ndarray:
    """X X' of an assay in long form (feature, sample, value) over the given samples: each
    feature becomes one row of values, rows are multiplied in batches. Missing cells are 0."""
    cells = placed(values.where(F.col("value").isNotNull()), "sample", samples)
    return gram(scattered(cells, "feature", len(samples), 0.0), len(samples))

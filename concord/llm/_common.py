"""Helpers shared by the corpus operators: shared storage, Arrow mapping, hashing."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame

from concord.sources.paths import delete_path, discard, materialize, shared_path  # noqa: F401

_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable):
    """What a worker keeps between tasks: the value of ``make()`` under ``key``. There is one
    at a time, so that a worker that turns to another stage or model lets the last one's
    caches go; tasks reach it because they call this by name."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the running bytes of one binary or string column pass
    ``max_bytes``; a single larger row stands alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    function: Callable[[list, list], dict],
    setup: Callable[[], None] | None = None,
    max_bytes: int = 16 << 20,
) -> DataFrame:
    """Apply ``function(ids, texts) -> {column: values}`` to bounded slices of
    ``(id_col, text_col)`` in Arrow batches. Other columns are pruned first, so
    names in them cannot clash."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup is not None:
            setup()
        for batch in batches:
            for part in slices(batch, 1, max_bytes):
                out = function(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Interner(dict):
    """A word -> value cache filled on demand by ``make``; emptied at ``limit``
    entries so that a worker's memory stays bounded whatever the vocabulary."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def sum_arrays(partials: DataFrame, dtype: str, fan_in: int = 64, written: bool = False) -> list:
    """Add up rows (key string, task int, data binary): zlib-packed numpy arrays of one
    length per key. Rounds of at most ``fan_in`` rows a group, so no task gathers more than
    that many arrays. Returns [(key, array)] on the driver: bounded by keys and length.
    ``written``: the rows were written and read again, so their partitions are no longer the
    tasks that numbered them, and the largest number is looked up."""
    import zlib

    from pyspark.sql import functions as F

    def add(rows):
        total = None
        for data in rows:
            part = np.frombuffer(zlib.decompress(data), dtype=dtype)
            total = part.copy() if total is None else np.add(total, part, out=total)
        return total

    def reduce(frame):
        import pandas as pd

        return pd.DataFrame({"key": [frame["key"].iloc[0]], "task": [int(frame["task"].iloc[0] // fan_in)], "data": [zlib.compress(add(frame["data"]).tobytes(), 1)]})

    tasks = (partials.agg(F.max("task")).first()[0] or 0) + 1 if written else max(1, partials.rdd.getNumPartitions())
    while tasks > 1:
        partials = partials.groupBy("key", F.floor(F.col("task") / fan_in).alias("block")).applyInPandas(lambda frame: reduce(frame), "key string, task int, data binary")
        tasks = -(-tasks // fan_in)
    rows = partials.orderBy("key").collect()
    if len({r.key for r in rows}) < len(rows):
        raise ValueError("several rows of a key are left: tasks have larger numbers than there are partitions")
    return [(r.key, add([r.data])) for r in rows]


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[list], list], max_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``df`` for whose texts ``keep`` gives true, all columns as they were; a
    map over bounded slices without a shuffle."""
    column = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                yield part.filter(pa.array(keep(part.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)

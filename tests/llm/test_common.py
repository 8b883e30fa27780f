"""Shared helpers: sums in rounds, bounded slices, shared storage."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from concord.llm import _common


def test_sums_in_rounds(spark):
    rows = [(k, t, zlib.compress(np.full(5, t + 1 if k == "a" else 1, "<i8").tobytes())) for t in range(23) for k in "ab" if t % 3 or k == "a"]
    frame = spark.createDataFrame(rows, "key string, task int, data binary").repartition(23)
    for fan_in in (2, 5, 64):
        got = {k: a.tolist() for k, a in _common.sum_arrays(frame, "<i8", fan_in)}
        assert got == {"a": [276] * 5, "b": [15] * 5}
    assert _common.sum_arrays(frame.limit(0), "<i8") == []


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aa", None, "b" * 50, "", "c", "dd"])], names=["i", "t"])
    parts = list(_common.slices(batch, 1, 4))
    assert sum(p.num_rows for p in parts) == 6 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 4 for p in parts)
    assert list(_common.slices(batch.slice(0, 0), 1)) == []


def test_cache_is_bounded():
    made = []
    cache = _common.Interner(lambda k: made.append(k) or k * 2, limit=3)
    assert [cache[k] for k in (1, 2, 3, 1, 4, 1)] == [2, 4, 6, 2, 8, 2] and made == [1, 2, 3, 4, 1] and len(cache) == 2


def test_filter_keeps_columns(spark):
    frame = spark.createDataFrame([(1, "a", 2.0), (None, None, None), (3, "b", 1.0)], "id int, text string, keep double")
    out = _common.filter_rows(frame, "text", lambda texts: [t != "a" for t in texts])
    assert out.schema == frame.schema and sorted(str(tuple(r)) for r in out.collect()) == ["(3, 'b', 1.0)", "(None, None, None)"]


def test_shared_folder(spark):
    path = _common.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    _common.delete_path(spark, path)
    assert _common.materialize(spark.range(4), "y").count() == 4


@pytest.mark.parametrize("tasks", [3, 70])
def test_sum_arrays_of_rows_read_again(spark, tmp_path, tasks):
    rows = [(k, n, zlib.compress(np.array([n, 1], "<i8").tobytes())) for k in "ab" for n in range(tasks)]
    spark.createDataFrame(rows, "key string, task int, data binary").coalesce(1).write.parquet(f"{tmp_path}/partials")
    frame = spark.read.parquet(f"{tmp_path}/partials")
    assert frame.rdd.getNumPartitions() < tasks
    got = [(k, a.tolist()) for k, a in _common.sum_arrays(frame, "<i8", written=True)]
    assert got == [(k, [tasks * (tasks - 1) // 2, tasks]) for k in "ab"]
    with pytest.raises(ValueError, match="several rows"):
        _common.sum_arrays(frame, "<i8")

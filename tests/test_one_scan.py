"""Tables that are parts of one frame are aligned from one scan of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.model import Block
from concord.operators.align import aligned
from concord.plans import queries
from concord.plans.fit import fit_incomplete


def scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.mark.parametrize("name, packed, most", [("status_blocks", False, 1), ("order_blocks", False, 2), ("month_blocks", True, 1), ("embedding_blocks", True, 1)])
def test_scans_of_registered_blocks(spark, sf, name, packed, most):
    blocks = getattr(queries, name)(spark, sf)
    together = aligned(blocks, packed, keep_missing=True)
    assert scans(together) == most
    alone = aligned({k: Block(b.frame, b.variables, b.id_col, b.layout) for k, b in blocks.items()}, packed, keep_missing=True)
    assert scans(alone) > most
    assert sorted(map(str, together.collect())) == sorted(map(str, alone.collect()))


@pytest.mark.parametrize("packed", [True, False])
def test_nulls_duplicates_and_names(spark, packed):
    """Null conditions are no rows, null ids one individual, ids that occur twice are counted."""
    source = spark.createDataFrame([("a", 1.0, 2.0, True), ("b", None, 3.0, None), (None, 4.0, 5.0, False), ("c", 6.0, 7.0, True), ("c", 6.0, 7.0, False)], "`the id` string, `x` double, `f0` double, here boolean")
    parts = {"p": Block.part(source, ["x"], "the id", where=F.col("here")), "q": Block.part(source, ["f0"], "the id"), "r": Block.wide(spark.createDataFrame([("z", 9.0)], "id string, x double"))}
    got = {r.id: (r.n0, r.n1, r.n2, r.ksum, r.x) for r in aligned(parts, packed).collect()}
    assert got == {"a": (1, 1, 0, 2, [1, 2, 0]), "b": (0, 1, 0, 1, [0, 3, 0]), None: (0, 1, 0, 1, [0, 5, 0]), "c": (1, 2, 0, 2, [6, 7, 0]), "z": (0, 0, 1, 1, [0, 0, 9])}
    empty = {k: Block.part(source.limit(0), ["x"], "the id") for k in "pq"}
    assert aligned(empty, packed).count() == 0


def test_a_changed_block_is_read_as_it_is(spark):
    rng = np.random.default_rng(1)
    source = spark.createDataFrame([(f"i{k}", *map(float, r)) for k, r in enumerate(rng.normal(size=(20, 3)))], "id string, a double, b double, c double")
    one, two = Block.part(source, ["a", "b"]), Block.part(source, ["c"])
    half = one.frame.where("id < 'i15'")
    from dataclasses import replace

    got = fit_incomplete({"x": replace(one, frame=half), "y": two}, nfac=1)
    want = fit_incomplete({"x": Block.wide(half), "y": Block.wide(source.select("id", "c"))}, nfac=1)
    assert got.eigenvalues == pytest.approx(want.eigenvalues)

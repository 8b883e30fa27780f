"""Fits of a stream against fits of the tables it makes up."""

import numpy as np
import pytest

from concord.model import Block
from concord.plans.fit import fit_incomplete
from concord.streaming.fits import GrowingFit

SCHEMA = "table string, id string, x array<double>, at bigint"
TABLES = {"a": ["a0", "a1", "a2"], "b": ["b0", "b1"], "c": ["c0"]}


def rows_of(seed, people=60, shift=0.0):
    """Rows in three parts; tables of one individual come apart, some rows come again anew."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=people)
    parts, last = [[], [], []], {}
    for i in range(people):
        for n, (t, names) in enumerate(TABLES.items()):
            if rng.random() < 0.25:
                continue
            for at in range(1 + (rng.random() < 0.4)):
                x = (base[i] + rng.normal(size=len(names)) + shift).tolist()
                parts[int(rng.integers(3))].append((t, f"i{i}", x, at))
                last[t, f"i{i}"] = max(last.get((t, f"i{i}"), (-1, [])), (at, x))
    parts[2] += parts[0][:20]  # repeated rows change nothing
    return parts, {t: [(i, x) for (name, i), (_, x) in last.items() if name == t] for t in TABLES}


def blocks(spark, tables):
    return {t: Block.packed(spark.createDataFrame(rows, "id string, x array<double>"), TABLES[t]) for t, rows in tables.items()}


def write(spark, part, path, mode="append"):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def streamed(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b, spark):
    assert np.allclose(a.eigenvalues, b.eigenvalues, rtol=1e-8)
    for frame, value in (("cors", "r"), ("p_values", "p")):
        got, want = ({(r["table"], r.var_pos, r.comp): r[value] for r in getattr(f, frame).collect()} for f in (a, b))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    if a.y is not None:
        got, want = ({r.id: (r.comp1, r.comp2) for r in f.y.collect()} for f in (a, b))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-7) for k in want)


def test_after_each_part_it_is_the_fit_of_the_tables(spark, tmp_path):
    parts, whole = rows_of(1)
    grown = GrowingFit(TABLES, f"{tmp_path}/moments")
    seen = {}
    for part in parts:
        write(spark, part, f"{tmp_path}/in")
        grown.start(streamed(spark, f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination()
        for t, i, x, at in part:
            seen[t, i] = max(seen.get((t, i), (-1, [])), (at, x))
        tables = blocks(spark, {t: [(i, x) for (name, i), (_, x) in seen.items() if name == t] for t in TABLES})
        want = fit_incomplete(tables, method="penalized", lam=[0.5, 1.0, 2.0])
        same(grown.fit(spark, method="penalized", lam=[0.5, 1.0, 2.0], tables=tables), want, spark)
        want.release()
    assert {t: sorted(map(str, r)) for t, r in whole.items()} == {t: sorted(str((i, x)) for (name, i), (_, x) in seen.items() if name == t) for t in TABLES}
    assert len(grown._numbers(spark)) <= 2  # older totals go


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    frame = spark.createDataFrame([(1.0, 1.0, [1.0, 1.0, 0.0, 0.0, 2.0, 1.0, 3.0, 0.0, 0.0, 0.0])], "sign double, ksum double, x array<double>")
    grown = GrowingFit(TABLES, f"{tmp_path}/moments")
    for number in (0, 1, 1, 1):
        grown.add(frame, number)
    assert grown.total(spark)[0][0, 0] == 2 and grown.total(spark)[0][4, 4] == 8
    grown.add(frame.limit(0), 2)
    assert grown.total(spark)[0][0, 0] == 2


def test_large_means_lose_few_digits_about_a_centre(spark, tmp_path):
    parts, whole = rows_of(2, shift=1e7)
    for part in parts:
        write(spark, part, f"{tmp_path}/in")
    grown = GrowingFit(TABLES, f"{tmp_path}/moments", {t: [1e7] * len(v) for t, v in TABLES.items()})
    grown.start(streamed(spark, f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination()
    tables = blocks(spark, whole)
    want = fit_incomplete(tables)
    same(grown.fit(spark, tables=tables), want, spark)
    want.release()


@pytest.mark.parametrize("row, told", [(("d", "i", [1.0], 0), "there is no table d"), (("c", None, [1.0], 0), "without an id"), (("c", "i", [float("nan")], 0), "missing values"), (("b", "i", [1.0], 0), "missing values"), (("c", "i", None, 0), "missing values")])
def test_rows_that_no_fit_takes(spark, tmp_path, row, told):
    write(spark, [row], f"{tmp_path}/in")
    query = GrowingFit(TABLES, f"{tmp_path}/moments").start(streamed(spark, f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match=told):
        query.awaitTermination()


def test_nothing_yet(spark, tmp_path):
    grown = GrowingFit(TABLES, f"{tmp_path}/moments")
    with pytest.raises(ValueError, match="has 0 rows"):
        grown.fit(spark)
    with pytest.raises(ValueError, match="variables"):
        GrowingFit({"a": []}, "")
    with pytest.raises(ValueError, match="about"):
        GrowingFit(TABLES, "", {"a": [1.0]})


def test_individuals_of_one_key_are_revised_apart(spark, tmp_path, monkeypatch):
    """State has fewer keys than there are individuals; whatever shares a key, the fit is the same."""
    from concord.streaming import fits

    assert fits.BUCKETS <= 4096  # one key an individual took a call of Python for each
    monkeypatch.setattr(fits, "BUCKETS", 3)
    parts, whole = rows_of(5)
    grown = GrowingFit(TABLES, f"{tmp_path}/moments")
    for part in parts:
        write(spark, part, f"{tmp_path}/in")
        grown.start(streamed(spark, f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination()
    tables = blocks(spark, whole)
    want = fit_incomplete(tables)
    same(grown.fit(spark, tables=tables), want, spark)
    want.release()

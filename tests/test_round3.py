"""Generalised inverses, dual scores, ordered ids, kernel leave-one-out, stored assays, drawings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.model import Assay, AssaySet, Block
from concord.operators import align, prep, select
from concord.plans import fit as fits
from concord.plans import solve, tune
from concord.sources import store
from tests.test_fit import dense, frame, random_tables, same_up_to_sign


@pytest.mark.parametrize("rank", [1, 3, 6])
def test_pivoted_cholesky_shows_the_rank(rank):
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(30, rank)) @ rng.normal(size=(rank, 6)) * [1, 1e3, 1e-3, 1, 10, 1]
    s = x.T @ x
    lower = solve.pivoted_cholesky(s)
    assert lower.shape == (6, rank) and np.allclose(lower @ lower.T, s, rtol=1e-8, atol=1e-9 * np.abs(s).max())
    well = rng.normal(size=(30, rank)) @ rng.normal(size=(rank, 6))
    half = solve.half_inverse(well.T @ well, 0.0, "t", ginv=True)
    assert np.allclose(half @ half.T, np.linalg.pinv(well.T @ well, rcond=1e-10), atol=1e-8)


def test_dependent_variables_with_generalised_inverses(spark):
    rng = np.random.default_rng(2)
    tables = random_tables(rng, (3, 4), 40, 0.8)
    wide = {f"t{n}": frame(spark, *t) for n, t in enumerate(tables)}
    plain = fits.fit_incomplete(wide, nfac=2, scores=True)
    doubled = {"t0": wide["t0"].selectExpr("*", "x0 + x1 x3", "2 * x2 - x0 x4"), "t1": wide["t1"]}
    with pytest.raises(ValueError, match="t0"):
        fits.fit_incomplete(doubled, nfac=2)
    got = fits.fit_incomplete(doubled, nfac=2, method="gi", scores=True)  # the same space, so the same components
    assert np.allclose(got.eigenvalues, plain.eigenvalues)
    a, b = ({r.id: (r.comp1, r.comp2) for r in f.y.collect()} for f in (got, plain))
    same_up_to_sign(np.array([a[i] for i in sorted(a)]), np.array([b[i] for i in sorted(a)]))
    a, b = ({(r.table, r.id): (r.comp1, r.comp2) for r in f.scores.collect()} for f in (got, plain))
    same_up_to_sign(np.array([a[i] for i in sorted(a)]), np.array([b[i] for i in sorted(a)]))
    same = fits.fit_incomplete(wide, nfac=2, method="ginv")
    assert np.allclose(same.eigenvalues, dense(tables, 2)["values"])
    with pytest.raises(ValueError, match="dense"):
        fits.fit_incomplete(wide, method="ginv", solver="iterative")


def test_dual_scores_equal_primal_ones(spark):
    tables = random_tables(np.random.default_rng(14), (9, 12), 16, 0.9)
    lam = [3.0, 4.0]
    primal = fits.fit_incomplete({f"t{n}": frame(spark, *t) for n, t in enumerate(tables)}, nfac=2, method="penalized", lam=lam, scores=True)
    long = {f"t{n}": spark.createDataFrame([(f"x{k}", i, float(x[r, k])) for r, i in enumerate(ids) for k in range(x.shape[1])], "feature string, sample string, value double") for n, (ids, x) in enumerate(tables)}
    dual = fits.fit_dual(long, lam, nfac=2, scores=True)
    a, b = ({(r.table, r.id): (r.comp1, r.comp2) for r in f.scores.collect()} for f in (primal, dual))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-8) for k in a)
    weights = {(r.table, r.variable, r.comp): r.weight for r in dual.weights.collect()}
    for n, (ids, x) in enumerate(tables):  # scores are rows times weights
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
        made = z @ np.array([[weights[f"t{n}", f"x{k}", c] for c in (1, 2)] for k in range(x.shape[1])])
        assert np.allclose(made, [b[f"t{n}", i] for i in ids], atol=1e-8)
    assert fits.fit_dual(long, lam).scores is None
    for spoil in (lambda d: d.where("feature <> 'x1' or sample <> 'p000' and sample <> 'p001'"), lambda d: d.unionByName(d.limit(1)), lambda d: d.withColumn("value", F.when(F.col("feature") == "x2", 5.0).otherwise(F.col("value")))):
        with pytest.raises(Exception, match="is constant, or lacks samples"):
            fits.fit_dual({"t0": spoil(long["t0"]), "t1": long["t1"]}, lam)
    dual.release()


def test_ids_in_order(spark):
    a = Block.wide(spark.createDataFrame([(f"b{n:03d}", n, float(n)) for n in range(50, 0, -1)], "id string, at int, v double").repartition(7), variables=["v"])
    b = Block.wide(spark.createDataFrame([("a", 2, 1.0), ("b007", 1, 2.0), ("Z", 3, 0.0), ("é", 3, 0.0)], "id string, at int, v double"), variables=["v"])
    places = lambda frame: [r.id for r in sorted(frame.collect(), key=lambda r: r.position)]
    got = align.id_union([a, b], order="sorted")
    assert places(got) == sorted({f"b{n:03d}" for n in range(1, 51)} | {"a", "Z", "é"}) and sorted(r.position for r in got.collect()) == list(range(53))
    assert places(align.id_union([a, b], "first", "at")) == [f"b{n:03d}" for n in range(1, 51)] + ["a", "Z", "é"]
    assert places(align.id_union([b, a], "first", "at"))[:5] == ["b007", "a", "Z", "é", "b001"]
    assert places(align.id_union([a, b], "auto", "at")) == places(got)
    assert places(align.id_union([b, b], "auto", "at")) == ["b007", "a", "Z", "é"]
    assert align.id_union([b.frame.limit(0)], "sorted").count() == 0
    for call in (lambda: align.id_union([a], "up"), lambda: align.id_union([a], "first")):
        with pytest.raises(ValueError):
            call()
    y = fits.fit_incomplete({"a": a, "b": Block.wide(a.frame.selectExpr("id", "v * v + at % 3 w"))}, nfac=1)
    assert places(y.in_order()) == [f"b{n:03d}" for n in range(1, 51)]


def test_kernel_looe_equals_the_primal_form(spark):
    rng = np.random.default_rng(9)
    for p in (3, 60):
        x = rng.normal(size=(20, p))
        y = x[:, 0] * 2 + rng.normal(size=20)
        lambdas = [0.1, 1.0, 7.0]
        long = spark.createDataFrame([(f"f{k}", f"s{n:02d}", float(x[n, k])) for n in range(20) for k in range(p)], "feature string, sample string, value double")
        target = spark.createDataFrame([(f"s{n:02d}", float(v)) for n, v in enumerate(y)], "sample string, value double")
        best, out, inverse, samples = tune.kernel_looe(long, target, lambdas)
        got = {r["lambda"]: r.looe for r in out.collect()}
        want = {}
        for v in lambdas:
            each = [y[k] - x[k] @ np.linalg.solve(np.delete(x, k, 0).T @ np.delete(x, k, 0) + v * np.eye(p), np.delete(x, k, 0).T @ np.delete(y, k)) for k in range(20)]
            want[v] = float(np.square(each).sum())
        assert all(got[v] == pytest.approx(want[v]) for v in lambdas) and best == min(want, key=want.get)
        assert samples == [f"s{n:02d}" for n in range(20)] and np.allclose(inverse, np.linalg.inv(x @ x.T + best * np.eye(20)))
        if p == 3:
            rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
            primal = {r["lambda"]: r.looe for r in tune.ridge_looe(rows, ["a", "b", "c"], "y", lambdas)[1].collect()}
            assert all(got[v] == pytest.approx(primal[v]) for v in lambdas)
    with pytest.raises(ValueError, match="one value"):
        tune.kernel_looe(long, target.unionByName(target))


def test_stored_assays_keep_all_that_is_known(spark, tmp_path):
    values = spark.createDataFrame([(f"f{n:03d}", s, float(n)) for n in range(300) for s in "xy"], "feature string, sample string, value double")
    known = spark.createDataFrame([(f"f{n:03d}", str(n % 3), n * 10, n * 10 + 5) for n in range(300)], "feature string, chrom string, start bigint, end bigint")
    people = spark.createDataFrame([("x", "alive"), ("y", "dead")], "sample string, vital_status string")
    path = f"{tmp_path}/set"
    names = store.write_assays(AssaySet({"m": Assay(values, known), "plain": Assay(values)}, people), path)
    back = store.read_assays(spark, path, names)
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(back.assays["m"].values) == rows(values) and rows(back.assays["m"].annotation) == rows(known) and rows(back.samples) == rows(people)
    assert back.assays["plain"].annotation is None
    wanted = prep.ranges(spark, "1:0-500")
    one, two = (prep.region(AssaySet({"m": a.assays["m"]}), wanted).assays["m"].values for a in (back, AssaySet({"m": Assay(values, known)})))
    assert rows(one) == rows(two) and one.count()
    some = store.read_assays(spark, path, ["m"], ("f010", "f019")).assays["m"]
    assert some.values.count() == 20 and some.annotation.count() == 10
    assert "GreaterThanOrEqual(feature,f010)" in some.values._jdf.queryExecution().toString()
    assert store.read_assays(spark, str(tmp_path), []).samples is None


def test_drawings_hold_all_points(spark):
    points = spark.range(30_000).selectExpr("cos(id) * id / 30000 x", "sin(id) * id / 30000 y", "if(id % 3 = 0, 'red', 'gray') color")
    found = select.plot_bins(points, 20).collect()
    assert sum(r.n for r in found) == 30_000 and len(found) <= 800 and all(0 <= r.bin_x < 20 and 0 <= r.bin_y < 20 for r in found)
    assert all(abs((r.x / r.reach + 1) / 2 * 20 - r.bin_x - 0.5) <= 0.5 + 1e-9 for r in found)
    text = select.svg(points, bins=20)
    assert text.count("<circle") == len(found) and sum(int(t.split("<")[0]) for t in text.split("<title>")[1:]) == 30_000
    assert select.svg(points.limit(0)).count("<circle") == 0

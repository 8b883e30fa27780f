"""The fits against a literal dense computation, properties, errors, and the driver's SQL."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from concord.functions.stats import correlation_p
from concord.model import Block, FitResult
from concord.plans import fit as fits
from concord.plans import queries, solve


def frame(spark, ids, x, names=None):
    names = names or [f"x{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in zip(ids, x)], "id string, " + ", ".join(f"{n} double" for n in names))


def dense(tables, nfac, lam=None, scale=True, complete=False):
    """Step by step with individuals x individuals matrices. tables: [(ids, matrix)]."""
    n = len(tables)
    union = sorted(set().union(*(ids for ids, _ in tables)))
    m = len(union)
    xs, ks = [], []
    for ids, x in tables:
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1) if scale else x
        full, k = np.zeros((m, x.shape[1])), np.zeros((m, m))
        for i, row in zip(ids, z):
            full[union.index(i)] = row
            k[union.index(i), union.index(i)] = 1
        xs.append(full)
        ks.append(k)
    lam = lam or [0.0] * n
    inv = [np.linalg.inv(x.T @ k @ x + v * np.eye(x.shape[1])) for x, k, v in zip(xs, ks, lam)]
    total = sum(k @ x @ i @ x.T @ k for x, k, i in zip(xs, ks, inv))
    ksum = sum(ks)
    half = np.diag(np.diag(ksum) ** -0.5)
    s = total if complete else half @ total @ half
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    values, vectors = values[::-1][:nfac], vectors[:, ::-1][:, :nfac]
    y = vectors if complete else np.sqrt(n) * half @ vectors
    out = {"ids": union, "values": values, "y": y, "cors": [], "scores": []}
    for (ids, _), x, k, i in zip(tables, xs, ks, inv):
        a = i @ x.T @ k @ y
        a = a / (k @ x @ a).std(axis=0, ddof=1)
        out["scores"].append(x @ a)
        where = [union.index(j) for j in ids]
        out["cors"].append(np.array([[np.corrcoef(x[where, v], y[where, c])[0, 1] for c in range(nfac)] for v in range(x.shape[1])]))
    return out


def same_up_to_sign(a, b, tol=1e-7):
    for c in range(a.shape[1]):
        assert min(np.abs(a[:, c] - b[:, c]).max(), np.abs(a[:, c] + b[:, c]).max()) < tol


def check(result: FitResult, want, names, nfac):
    comps = [f"comp{c + 1}" for c in range(nfac)]
    assert np.allclose(result.eigenvalues, want["values"], atol=1e-9)
    rows = {r["id"]: [r[c] for c in comps] for r in result.y.collect()}
    same_up_to_sign(np.array([rows[i] for i in want["ids"]]), want["y"])
    for t, name in enumerate(names):
        own = sorted((r.var_pos, r.comp, r.r) for r in result.cors.where(f"table = '{name}'").collect())
        got = np.array([r for _, _, r in own]).reshape(-1, nfac)
        same_up_to_sign(got, want["cors"][t])
        if result.scores is not None:
            scores = {r["id"]: [r[c] for c in comps] for r in result.scores.where(f"table = '{name}'").collect()}
            same_up_to_sign(np.array([scores[i] for i in want["ids"]]), want["scores"][t])
        tested = {(r.var_pos, r.comp): r.p for r in result.p_values.where(f"table = '{name}'").collect()}
        for (v, c, r) in own:
            assert tested[v, c] == pytest.approx(correlation_p(np.array([r]), len(want["ids"]))[0], rel=1e-9)
        ave = {r.comp: r.ave for r in result.ave_x.where(f"table = '{name}'").collect()}
        assert np.allclose([ave[c + 1] for c in range(nfac)], (want["cors"][t] ** 2).mean(axis=0))
    widths = np.array([len(c) for c in want["cors"]])
    outer = {r.comp: r.ave for r in result.ave_outer.collect()}
    assert np.allclose([outer[c + 1] for c in range(nfac)], widths @ np.array([(c**2).mean(axis=0) for c in want["cors"]]) / widths.sum())


def random_tables(rng, widths, people, present):
    ids = [f"p{k:03d}" for k in range(people)]
    base = rng.normal(size=(people, 2))
    out = []
    for w in widths:
        keep = sorted(rng.choice(people, size=max(w + 3, int(people * present)), replace=False)) if present < 1 else range(people)
        x = base @ rng.normal(size=(2, w)) + rng.normal(size=(people, w)) + rng.normal()
        out.append(([ids[k] for k in keep], x[list(keep)]))
    return out


@pytest.mark.parametrize(("widths", "lam", "scale"), [((3, 2, 4), None, True), ((1, 1), None, True), ((2, 5), [0.5, 30.0], True), ((3, 3), None, False)])
def test_incomplete_fit_equals_dense(spark, widths, lam, scale):
    rng = np.random.default_rng(sum(widths))
    tables = random_tables(rng, widths, 40, 0.8)
    nfac = min(2, sum(widths))
    want = dense(tables, nfac, lam, scale)
    method = "penalized" if lam else "solve"
    wide = {f"t{n}": frame(spark, *t) for n, t in enumerate(tables)}
    check(fits.fit_incomplete(wide, nfac=nfac, scores=True, method=method, lam=lam, scale=scale), want, list(wide), nfac)
    check(fits.fit_packed(wide, nfac=nfac, scores=True, method=method, lam=lam, scale=scale), want, list(wide), nfac)


def test_many_variables_in_arrays(spark):
    rng = np.random.default_rng(5)
    tables = random_tables(rng, (60, 70), 190, 0.9)
    want = dense(tables, 3)
    blocks = {f"t{n}": Block.packed(spark.createDataFrame([(i, r.tolist()) for i, r in zip(*t)], "id string, x array<double>"), [f"v{k}" for k in range(t[1].shape[1])]) for n, t in enumerate(tables)}
    check(fits.fit_incomplete(blocks, nfac=3, scores=True), want, list(blocks), 3)


def test_complete_fit_and_its_relation_to_the_other(spark):
    tables = random_tables(np.random.default_rng(3), (2, 3, 2), 30, 1)
    wide = [frame(spark, *t) for t in tables]
    one, two = fits.fit_complete(wide, nfac=2, scores=True), fits.fit_incomplete(wide, nfac=2)
    check(one, dense(tables, 2, complete=True), ["df1", "df2", "df3"], 2)
    assert np.allclose(one.eigenvalues, 3 * np.array(two.eigenvalues))
    a, b = ({r.id: (r.comp1, r.comp2) for r in f.y.collect()} for f in (one, two))
    assert all(np.allclose(a[i], b[i]) for i in a)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.integers(0, 10_000), st.lists(st.integers(1, 4), min_size=2, max_size=4), st.floats(0.5, 1), st.booleans())
def test_solver_equals_dense(seed, widths, present, penalized):
    rng = np.random.default_rng(seed)
    tables = random_tables(rng, widths, 25, present)
    lam = [float(v) for v in rng.uniform(0.1, 20, len(widths))] if penalized else [0.0] * len(widths)
    want = dense(tables, 1, lam)
    union = want["ids"]
    xs = []
    for ids, x in tables:
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
        full = np.zeros((len(union), x.shape[1]))
        full[[union.index(i) for i in ids]] = z
        xs.append(full)
    k = sum(np.isin(union, ids).astype(float) for ids, _ in tables)
    x = np.hstack(xs)
    found = solve.solve(x.T @ x, x.T @ (x / k[:, None]), x.sum(axis=0), widths, [str(n) for n in range(len(widths))], lam, 1, len(union))
    assert np.allclose(found.values, want["values"], atol=1e-9) and -1e-9 <= found.values[0] <= 1 + 1e-9
    y = x @ found.loadings / k[:, None]
    assert y.T @ (y * k[:, None]) == pytest.approx(len(widths))
    starts = np.concatenate([[0], np.cumsum(widths)])
    for n, w in enumerate(found.weights):
        assert (x[:, starts[n] : starts[n + 1]] @ w).std(axis=0, ddof=1) == pytest.approx(1)


def test_order_and_unit_do_not_matter(spark):
    tables = random_tables(np.random.default_rng(9), (2, 2), 30, 0.8)
    wide = {"a": frame(spark, *tables[0]), "b": frame(spark, *tables[1])}
    base = fits.fit_incomplete(wide)
    turned = fits.fit_incomplete({"b": wide["b"].orderBy("x1"), "a": wide["a"].selectExpr("id", "x0 * 7 + 3 x0", "x1")})
    assert np.allclose(base.eigenvalues, turned.eigenvalues)
    small = fits.fit_incomplete(wide, method="penalized", lam=[1e-9, 1e-9])
    assert np.allclose(base.eigenvalues, small.eigenvalues, atol=1e-8)


def test_dual_equals_primal(spark):
    rng = np.random.default_rng(4)
    tables = random_tables(rng, (8, 9), 14, 0.9)
    lam = [3.0, 4.0]
    primal = fits.fit_incomplete({f"t{n}": frame(spark, *t, [f"x{k}" for k in range(t[1].shape[1])]) for n, t in enumerate(tables)}, nfac=2, method="penalized", lam=lam)
    long = {f"t{n}": spark.createDataFrame([(f"x{k}", i, float(x[r, k])) for r, i in enumerate(ids) for k in range(x.shape[1])], "feature string, sample string, value double") for n, (ids, x) in enumerate(tables)}
    dual = fits.fit_dual(long, lam, nfac=2)
    assert np.allclose(primal.eigenvalues, dual.eigenvalues)
    a, b = ({r.id: (r.comp1, r.comp2) for r in f.y.collect()} for f in (primal, dual))
    assert all(np.allclose(a[i], b[i], atol=1e-8) for i in a)
    a, b = ({(r.table, r.variable, r.comp): r.r for r in f.cors.collect()} for f in (primal, dual))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    a, b = ({(r.table, r.variable, r.comp): r.p for r in f.p_values.collect()} for f in (primal, dual))
    assert all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a)


def test_dual_computes_an_assay_once_and_fills(spark):
    rng = np.random.default_rng(21)
    schema, counter = "feature long, sample string, value double", spark.sparkContext.accumulator(0)
    cells = {k: [(f, f"s{j}", float(rng.normal())) for f in range(40) for j in range(6) if (f + j) % 5 or not f] for k in "ab"}
    zeros = {k: own + [(f, f"s{j}", 0.0) for f in range(1, 40) for j in range(6) if not (f + j) % 5] for k, own in cells.items()}

    def seen(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    gaps = {k: spark.createDataFrame(own, schema) for k, own in cells.items()}
    got = fits.fit_dual({k: d.mapInArrow(seen, schema) for k, d in gaps.items()}, [3.0, 4.0], nfac=2, fill=0.0)
    want = fits.fit_dual({k: spark.createDataFrame(own, schema) for k, own in zeros.items()}, [3.0, 4.0], nfac=2)
    assert np.allclose(got.eigenvalues, want.eigenvalues, atol=1e-12)
    a, b = ({(r.table, r.variable, r.comp): r.r for r in f.cors.collect()} for f in (got, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert counter.value == sum(map(len, cells.values()))
    twice, nameless = (gaps["a"].unionByName(spark.createDataFrame(more, schema)) for more in (cells["a"][:1], [(None, "s0", 1.0)]))
    for assay, fill in ((gaps["a"], None), (twice, 0.0), (nameless, 0.0)):
        with pytest.raises(Exception, match="is constant, or lacks samples"):
            fits.fit_dual({"a": assay, "b": gaps["b"]}, [3.0, 4.0], fill=fill)


def test_dual_fit_of_totals(spark, sf):
    """One shuffle makes the totals; the eigenvalues are those of a literal computation."""
    orders, lines = (spark.read.parquet(f"{sf}/{n}.parquet").toPandas() for n in ("orders", "lineitem"))
    lines = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    total = 0
    for own, by, value, lam in ((orders, "o_custkey", "o_totalprice", 5.0), (lines, "l_partkey", "l_extendedprice", 7.0)):
        x = own.pivot_table(index=by, columns="o_orderpriority", values=value, aggfunc="sum", fill_value=0.0).to_numpy(float)
        z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
        total = total + z.T @ z @ np.linalg.inv(z.T @ z + lam * np.eye(5)) / 2
    want = np.linalg.eigvalsh((total + total.T) / 2)[::-1][:3]
    assert [r.eigenvalue for r in queries.dual_fit(spark, sf).orderBy("comp").collect()] == pytest.approx(want, abs=1e-6)
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey feature", "o_orderpriority sample", "o_totalprice value")
    plan = queries.priority_totals(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_errors(spark):
    tables = random_tables(np.random.default_rng(1), (2, 2), 12, 1)
    a, b = (frame(spark, *t) for t in tables)
    for call, words in [
        (lambda: fits.fit_incomplete([a, b], method="geninv"), "method"),
        (lambda: fits.fit_incomplete([a, b], method=""), "method"),
        (lambda: fits.fit_incomplete([a, b], method="penalized"), "lam"),
        (lambda: fits.fit_incomplete([a, b], method="penalized", lam=[1.0]), "lam"),
        (lambda: fits.fit_incomplete("x"), "list"),
        (lambda: fits.fit_incomplete([]), "no table"),
        (lambda: fits.fit_incomplete([a.selectExpr("id", "if(x0 > 0, x0, null) x0"), b]), "missing values in x0"),
        (lambda: fits.fit_incomplete([a.selectExpr("id", "if(x0 > 0, x0, double('NaN')) x0"), b]), "missing values"),
        (lambda: fits.fit_incomplete([a.selectExpr("id", "1.5D c", "x1"), b]), "c is constant"),
        (lambda: fits.fit_incomplete([a.selectExpr("id", "x0", "2 * x0 y"), b]), "df1"),
        (lambda: fits.fit_incomplete([a, b], nfac=5), "fewer than 5"),
        (lambda: fits.fit_incomplete([a.union(a.limit(1)), b]), "several rows"),
        (lambda: fits.fit_complete([a.limit(9), b]), "complete"),
        (lambda: fits.fit_complete([a.selectExpr("concat(id, 'z') id", "x0"), b]), "complete"),
        (lambda: fits.fit_incomplete([a, b], on_duplicate="first"), "order_col"),
    ]:
        with pytest.raises(ValueError, match=words):
            call()


def test_duplicates_keep_the_first(spark):
    ids, x = random_tables(np.random.default_rng(2), (2,), 12, 1)[0]
    a = spark.createDataFrame([(i, *map(float, r), n) for n, (i, r) in enumerate(zip([*ids, ids[0]], [*x, x[3]]))], "id string, x0 double, x1 double, place int")
    b = frame(spark, ids, np.random.default_rng(3).normal(size=(12, 2))).selectExpr("*", "1 place")
    out = fits.fit_incomplete({"a": a, "b": b}, on_duplicate="first", order_col="place")
    assert out.n_ids == 12 and out.y.count() == 12


def test_p_values_agree_with_the_jvm(spark):
    jvm = spark.sparkContext._jvm
    for n in (3, 4, 10, 57, 1500, 200_000):
        t = jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 2))
        for r in (0.0, 1e-4, 0.03, 0.4, 0.9, 0.999, -0.7):
            x = abs(r) * np.sqrt(n - 2) / np.sqrt(1 - r * r)
            want = 2 * t.cumulativeProbability(float(-x))
            got = correlation_p(np.array([r]), n)[0]
            assert got == pytest.approx(want, rel=1e-7, abs=1e-290)
    assert correlation_p(np.array([1.0, -1.0, np.nan]), 9)[:2].tolist() == [0, 0] and np.isnan(correlation_p(np.array([0.5]), 2)[0])

"""Preparation, selection, tuning, storage, streaming and the driver's contract."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions import columns as C
from concord.model import Assay, AssaySet, Block, TableList
from concord.operators import align, moments, prep, select
from concord.plans import fit as fits
from concord.plans import tune
from concord.sources import store
from concord.streaming.growing import GrowingMoments


def long(spark, rows):
    return spark.createDataFrame(rows, "feature string, sample string, value double")


@pytest.fixture(scope="module")
def result(spark):
    rng = np.random.default_rng(1)
    ids = [f"i{k:02d}" for k in range(30)]
    base = rng.normal(size=30)
    frames = []
    for n, w in enumerate((4, 3)):
        x = base[:, None] * rng.normal(size=w) + rng.normal(size=(30, w))
        frames.append(spark.createDataFrame([(i, *map(float, r)) for i, r in zip(ids, x)], "id string, " + ", ".join(f"v{n}{k} double" for k in range(w))))
    return fits.fit_incomplete({"a": frames[0], "b": frames[1]}, scores=True)


def test_casts_and_nulls(spark):
    b = Block.wide(spark.createDataFrame([("a", " 3 ", "NA"), ("b", "x", "1e3"), ("c", None, "-0.5")], "id string, p string, q string"))
    out = prep.to_numbers(TableList({"t": b}), 1).tables["t"].frame.orderBy("id").collect()
    assert [(r.p, r.q) for r in out] == [(3.0, None), (None, 1000.0), (None, -0.5)]
    for bad in (0, 2, "z"):
        with pytest.raises(ValueError):
            prep.to_numbers(TableList({"t": b}), bad)
    with pytest.raises(ValueError):
        prep.to_numbers({"t": b}, 1)
    assert "1 tables" in repr(TableList({"t": b})) and "1 assays" in repr(AssaySet({"x": Assay(b.frame)}))
    zero = prep.zeros_to_nulls(spark.createDataFrame([(0.0, 1.0), (2.0, 0.0), (None, -0.0)], "a double, b double"), ["a", "b"])
    assert [tuple(r) for r in zero.collect()] == [(None, 1.0), (2.0, None), (None, None)]
    assert prep.clean_ids(Block.wide(spark.createDataFrame([("TCGA-AA-1234-01A", 1.0)], "id string, v double"))).frame.first()["id"] == "TCGA-AA-1234"
    assert prep.head_variables(b, 1).variables == ("p",)


def test_alignment(spark):
    a = Block.wide(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "id string, v double"))
    b = Block.wide(spark.createDataFrame([("y", 5.0), ("z", 6.0)], "id string, v double"))
    for packed in (False, True):
        rows = {r.id: (r.n0, r.n1, r.ksum, r.x) for r in align.aligned({"a": a, "b": b}, packed).collect()}
        assert rows == {"x": (1, 0, 1, [1.0, 0.0]), "y": (1, 1, 2, [2.0, 5.0]), "z": (0, 1, 1, [0.0, 6.0])}
    assert {r.id for r in align.id_absent(b, a).collect()} == {"z"} and {r.id for r in align.id_intersect(a, b).collect()} == {"y"}


def test_gram_paths_agree(spark):
    x = np.random.default_rng(2).normal(size=(57, 30))
    rows = spark.createDataFrame([(r.tolist(), float(n % 3 + 1)) for n, r in enumerate(x)], "x array<double>, w double").repartition(20)
    weights = np.array([n % 3 + 1 for n in range(57)])
    assert np.allclose(moments.gram(rows, 30, weight="w"), (x * weights[:, None]).T @ x)
    small = rows.select(F.slice("x", 1, 5).alias("x"))
    assert np.allclose(moments.gram(small, 5), x[:, :5].T @ x[:, :5])
    stats = moments.column_stats(Block.packed(rows.select(F.monotonically_increasing_id().alias("id"), "x"), [f"v{k}" for k in range(30)]))
    assert stats["n"] == 57 and np.allclose(stats["mean"], x.mean(axis=0)) and np.allclose(stats["sd"], x.std(axis=0, ddof=1))


def test_ranges(spark):
    features = spark.createDataFrame([("a", "11", 100, 100, 200), ("b", "11", 201, 150, 260), ("c", "12", 150, 120, 130), ("d", "11", 99, 100, 201)], "feature string, chrom string, coord bigint, start bigint, end bigint")
    wanted = prep.ranges(spark, ["11:100-201", "11:100-200"])
    names = lambda df: sorted(r.feature for r in df.collect())
    assert names(prep.point_filter(features, wanted)) == ["a", "b"]
    assert names(prep.point_filter(features, wanted, match_chrom=False)) == ["a", "b", "c"]
    assert names(prep.point_filter(features.withColumn("coord", F.col("coord").cast("string")), wanted)) == ["a", "b"]
    assert names(prep.within_filter(features, wanted)) == ["a", "d"]
    values = long(spark, [(f, s, 1.0) for f in "abcd" for s in "xy"])
    both = AssaySet({"p": Assay(values, features), "r": Assay(values, features)})
    out = prep.region(both, wanted, ["p"], "coord")
    assert names(out.assays["p"].values.select("feature").distinct()) == ["a", "b"] and names(out.assays["r"].annotation) == ["a", "d"]
    for call in (lambda: prep.ranges(spark, "11:x-y"), lambda: prep.point_filter(features, wanted, "nope"), lambda: prep.region(both, wanted, ["q"]), lambda: prep.region({}, wanted), lambda: prep.region(AssaySet({"p": Assay(values)}), wanted), lambda: prep.within_filter(values, wanted)):
        with pytest.raises(ValueError):
            call()


def slow_knn(cells, k, rowmax):
    features, samples = sorted({f for f, _ in cells}), sorted({s for _, s in cells})
    mean = {s: np.mean([cells[f, s] for f in features if cells[f, s] is not None]) for s in samples}
    out = {}
    for f in features:
        gaps = [s for s in samples if cells[f, s] is None]
        for s in samples:
            if cells[f, s] is not None:
                out[f, s] = cells[f, s]
                continue
            near = []
            if len(gaps) <= rowmax * len(samples):
                for g in features:
                    both = [t for t in samples if cells[f, t] is not None and cells[g, t] is not None]
                    if g != f and both and cells[g, s] is not None:
                        near.append((sum((cells[f, t] - cells[g, t]) ** 2 for t in both) / len(both), g))
            near = sorted(near)[:k]
            out[f, s] = np.mean([cells[g, s] for _, g in near]) if near else mean[s]
    return out


@pytest.mark.parametrize("block", [64 << 20, 300])
def test_knn_imputation(spark, block):
    rnd = random.Random(4)
    cells = {(f"f{n:02d}", f"s{k}"): None if rnd.random() < 0.2 else rnd.random() for n in range(25) for k in range(5)}
    for k in range(4):
        cells["f03", f"s{k}"] = None
    frame = long(spark, [(f, s, v) for (f, s), v in cells.items()])
    got = {(r.feature, r["sample"]): r.value for r in prep.knn_impute(frame, k=3, max_block_bytes=block).collect()}
    want = slow_knn(cells, 3, 0.5)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_impute(spark):
    rows = [(f, s, v) for f, vs in (("a", (1.0, 0.0, 3.0, None)), ("b", (1.5, 2.0, 3.5, None)), ("c", (9.0, 8.0, 7.0, 1.0))) for s, v in zip("wxyz", vs)]
    out = prep.impute(AssaySet({"m": Assay(long(spark, rows))}), remove_col=True, impute_zero=True, colmax=0.5, k=1).assays["m"].values
    got = {(r.feature, r["sample"]): r.value for r in out.collect()}
    assert got["a", "x"] == 2.0 and not any(s == "z" for _, s in got)
    whole = AssaySet({"m": Assay(long(spark, rows))})
    with pytest.raises(ValueError, match="miss more"):
        prep.impute(whole, colmax=0.5)
    with pytest.raises(NotImplementedError):
        prep.impute(whole, "hmisc")
    with pytest.raises(ValueError):
        prep.impute(whole, "other")
    with pytest.raises(ValueError, match="two features"):
        prep.knn_impute(long(spark, [("a", "x", 1.0)]))


def test_transposition(spark):
    rows = [(f, s, float(n)) for n, (f, s) in enumerate((f, s) for f in "abc" for s in "xy" if (f, s) != ("b", "y"))]
    narrow = prep.tables_of(AssaySet({"m": Assay(long(spark, rows))})).tables["m"]
    packed = prep.tables_of(AssaySet({"m": Assay(long(spark, rows))}), wide=2).tables["m"]
    a = {r["id"]: [r[v] for v in narrow.variables] for r in narrow.frame.collect()}
    assert a == {r["id"]: r["x"] for r in packed.frame.collect()} == {"x": [0.0, 2.0, 3.0], "y": [1.0, None, 4.0]}


def test_selection(spark, result):
    rows = [(r.table, r.var_pos, r.variable, r.comp, r.r) for r in result.cors.collect()]
    for end, sign in (("pos", -1), ("neg", 1)):
        got = [(r.table, r["rank"], r.variable) for r in select.top_vars(result, 1, end, 9).orderBy("table", "rank").collect()]
        assert got == [(t, n + 1, v) for t in "ab" for n, (_, _, v) in enumerate(sorted((sign * r, p, v) for tt, p, v, c, r in rows if tt == t and c == 1)[:3])]
    p = {(r.table, r.variable, r.comp): r.p for r in result.p_values.collect()}
    some = select.get_signif(result, pval_cut=1e-2).collect()
    assert [(r.table, r.variable) for r in some] == [(t, v) for t, _, v in sorted({(t, q, v) for t, q, v, c, r in rows if p[t, v, c] < 1e-2})]
    assert {r.table for r in select.get_signif(result, df=2, pval_cut=1.1).collect()} == {"b"} and select.get_signif(result, pval_cut=0.0).count() == 0
    cut = select.top_vars(result, 1, "pos", pval_cut=0.5).collect()
    assert {r.variable for r in cut} == {v for t, q, v, c, r in rows if c == 1 and r > 0 and p[t, v, 1] <= 0.5}
    for call in (lambda: select.top_vars(result, end="up"), lambda: select.top_vars({}), lambda: select.get_signif(result, df="z"), lambda: select.get_signif(result, df=3), lambda: select.plot_individuals(result, axes=(1, 9)), lambda: select.plot_variables(result, axes=(1,))):
        with pytest.raises(ValueError):
            call()


def test_plots(spark, result):
    groups = result.y.selectExpr("id", "if(id < 'i10', 'low', 'high') `group`").where("id <> 'i03'")
    rows = {r.id: r for r in select.plot_individuals(result, groups).collect()}
    assert len(rows) == 30 and (rows["i05"].color, rows["i20"].color, rows["i03"].color) == ("blue", "red", None)
    with pytest.raises(ValueError, match="colors"):
        select.plot_individuals(result, groups, colors=["red"])
    assert len(set(select.palette(12))) == 12
    with pytest.warns(UserWarning, match="nope"):
        marked = select.plot_variables(result, ["v00", "nope"], min_r=2.0).collect()
    assert [r.variable for r in marked if r.highlighted] == ["v00"] and not any(r.labelled for r in marked)
    assert select.svg(select.plot_variables(result)).count("<circle") == 7
    assert select.unit_circle(spark).selectExpr("max(abs(x*x+y*y-1)) e").first().e < 1e-12
    assert spark.range(1).selectExpr("1 a", "3 b", "3 c").select(C.label_of_largest(["a", "b", "c"]).alias("l")).first().l == "b"


def test_leave_one_out_grid(spark):
    rng = np.random.default_rng(6)
    x1, x2 = rng.normal(size=(14, 2)), rng.normal(size=(14, 3))
    x2[:, 0] += x1[:, 0]
    ids = [f"i{k}" for k in range(14)]
    frames = [spark.createDataFrame([(i, *map(float, r)) for i, r in zip(ids, x)], "id string, " + ", ".join(f"v{k} double" for k in range(x.shape[1]))) for x in (x1, x2)]
    best, out = tune.leave_one_out_grid(*frames, [0.5, 6.0], [1.0, 30.0])
    want = {}
    from tests.test_fit import dense

    for a in (0.5, 6.0):
        for b in (1.0, 30.0):
            each = []
            for k in range(14):
                left = [i for n, i in enumerate(ids) if n != k]
                cors = dense([(left, np.delete(x1, k, 0)), (left, np.delete(x2, k, 0))], 2, [a, b])["cors"]
                each.append(np.mean(np.vstack(cors) ** 2, axis=0).mean())
            want[a, b] = np.mean(each)
    got = {(r.lambda1, r.lambda2): r.mean_ave for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and best == max(want, key=want.get)
    assert prep.grid([1, 2], [3, 4]) == [(1, 3), (2, 3), (1, 4), (2, 4)]


def test_ridge(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3))
    y = x @ [2.4, 1.6, -0.4] + rng.normal(size=40)
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    for lam in (0.01, 5.0):
        dual = x.T @ tune.ridge_inverse(x @ x.T, lam) @ y
        assert np.allclose(list(tune.ridge_solve(frame, ["a", "b", "c"], "y", lam).values()), dual)
    best, out = tune.ridge_looe(frame, ["a", "b", "c"], "y", [0.1, 1.0, 10.0])
    want = {v: sum((y[k] - x[k] @ np.linalg.solve(np.delete(x, k, 0).T @ np.delete(x, k, 0) + v * np.eye(3), np.delete(x, k, 0).T @ np.delete(y, k))) ** 2 for k in range(40)) for v in (0.1, 1.0, 10.0)}
    got = {r["lambda"]: r.looe for r in out.collect()}
    assert all(got[v] == pytest.approx(want[v]) for v in want) and best == min(want, key=want.get)
    m = x.T @ x
    assert np.allclose(tune.ridge_inverse(m, 1, one_is_none=True), np.linalg.inv(m)) and np.allclose(tune.ridge_inverse(None, 2.0, np.linalg.eigh(m)), np.linalg.inv(m + 2 * np.eye(3)))
    with pytest.raises(ValueError):
        tune.ridge_inverse()


def test_storage(spark, result, tmp_path):
    assert "scores" in result.save(f"{tmp_path}/fit")
    back = store.read_fit(spark, f"{tmp_path}/fit", ["cors", "y"])
    assert sorted(map(tuple, back["cors"].collect())) == sorted(map(tuple, result.cors.collect()))
    names = store.write_assays(AssaySet({"m": Assay(long(spark, [("a", "x", 1.0)]))}), str(tmp_path))
    assert [tuple(r) for r in store.read_assays(spark, str(tmp_path), names).assays["m"].values.collect()] == [("a", "x", 1.0)]
    y = result.y.selectExpr("id", "comp1 + rand(3) c")
    store.write_tables({"a": Block.wide(y), "b": Block.wide(y.selectExpr("id", "c + rand(4) d"))}, str(tmp_path))
    out = store.fit_from_path(spark, str(tmp_path), ["a", "b"], nfac=1)
    assert spark.read.parquet(f"{tmp_path}/out/ave_inner").first().eigenvalue == pytest.approx(out.eigenvalues[0])


def test_stream_moments(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(60, 2))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    rows.write.parquet(f"{tmp_path}/in")
    grown = GrowingMoments(["a", "b"], f"{tmp_path}/moments")
    stream = spark.readStream.schema("a double, b double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    grown.start(stream, f"{tmp_path}/checkpoint").awaitTermination()
    grown.add(rows.limit(0), 99)
    n, sums, products = grown.total(spark)
    assert n == 60 and np.allclose(sums, x.sum(axis=0)) and np.allclose(products, x.T @ x)
    assert np.allclose(grown.correlations(spark), np.corrcoef(x.T))


def test_contract(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from concord.plans import queries

    assert entry.entry(spark).count() == 128
    assert set(entry.oracle_sql()) <= set(entry.queries())
    db = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part", "events", "embeddings"):
        db.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name in ("incomplete_components_1var", "scores_1var", "complete_eig_2var", "knn_impute", "range_within", "loo_cv_1var", "presence_ksum"):
        got = queries.QUERIES[name](spark, sf)
        want = db.sql(queries.SQL[name]).fetchall()
        names = [d[0] for d in db.sql(queries.SQL[name]).description]
        assert sorted(map(str, map(tuple, got.select(*(f"`{n}`" for n in names)).collect()))) == sorted(map(str, want)), name


def test_dual_fit_query_takes_all_rows(spark, sf):
    pd = pytest.importorskip("pandas")
    from concord.plans import queries

    orders, lines = (pd.read_parquet(f"{sf}/{n}.parquet") for n in ("orders", "lineitem"))
    lines = lines.merge(orders[["o_orderkey", "o_orderpriority"]], left_on="l_orderkey", right_on="o_orderkey")
    total = np.zeros((5, 5))
    for rows, key, value, lam in ((orders, "o_custkey", "o_totalprice", 5.0), (lines, "l_partkey", "l_extendedprice", 7.0)):
        x = rows.pivot_table(index="o_orderpriority", columns=key, values=value, aggfunc="sum", fill_value=0.0).to_numpy(float)
        assert x.shape == (5, rows[key].nunique())
        z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
        total += z @ z.T @ np.linalg.inv(z @ z.T + lam * np.eye(5)) / 2
    want = np.sort(np.linalg.eigvalsh((total + total.T) / 2))[::-1][:3]
    got = [r.eigenvalue for r in queries.QUERIES["dual_fit"](spark, sf).orderBy("comp").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_ranked_and_tested_variables_are_all_64(spark, sf):
    pd = pytest.importorskip("pandas")
    from concord.functions.stats import correlation_p
    from concord.plans import queries

    x = np.stack(pd.read_parquet(f"{sf}/embeddings.parquet")["embedding"]).astype(float)
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    blocks = np.split(x, 4, axis=1)
    vectors = np.linalg.eigh(sum(b @ np.linalg.pinv(b) for b in blocks))[1][:, ::-1][:, :2]
    products = x.T @ vectors
    vectors *= np.sign(products[np.abs(products).argmax(axis=0), [0, 1]])
    r = np.corrcoef(x.T, vectors.T)[:64, 64:]
    p = correlation_p(r, len(x))
    rows = lambda name: queries.QUERIES[name](spark, sf).collect()
    tested = {(t.variable, t.comp): t.p for t in rows("p_values")}
    assert set(tested) == {(f"e{v}", c) for v in range(64) for c in (1, 2)}
    assert all(np.isclose(tested[f"e{v}", c + 1], p[v, c], rtol=1e-6, atol=1e-12) for v in range(64) for c in (0, 1))
    for name, c, sign, n in (("fit_top_vars_pos", 0, -1, 3), ("fit_top_vars_neg", 1, 1, 9)):
        want = {(f"b{b}", k + 1, f"e{16 * b + v}") for b in range(4) for k, v in enumerate(np.argsort(sign * r[16 * b : 16 * b + 16, c])[:n])}
        assert {(t.table, t["rank"], t.variable) for t in rows(name)} == want
    assert {t.variable for t in rows("fit_top_vars_pcut")} == {f"e{v}" for v in range(64) if r[v, 0] < 0 and p[v, 0] <= queries.CUT}
    assert {t.variable for t in rows("fit_significant_vars")} == {f"e{v}" for v in range(64) if (p[v] < queries.CUT).any()}


def test_incomplete_eig_wide_takes_all_rows(spark, sf):
    pd = pytest.importorskip("pandas")
    from concord.plans import queries

    orders = pd.read_parquet(f"{sf}/orders.parquet")
    ids = np.sort(orders.o_custkey.unique())
    total, ksum, spent = np.zeros((len(ids), len(ids))), np.zeros(len(ids)), 0.0
    for p in queries.PRIORITIES:
        own = orders[orders.o_orderpriority == p]
        x = own.pivot_table(index="o_custkey", columns=own.o_orderdate.dt.month, values="o_totalprice", aggfunc="sum", fill_value=0.0)
        spent += x.to_numpy(float).sum()
        z, at = ((x - x.mean()) / x.std()).to_numpy(float), np.searchsorted(ids, x.index)
        assert z.shape[1] == 12
        total[np.ix_(at, at)] += z @ np.linalg.pinv(z)
        ksum[at] += 1
    assert np.isclose(spent, orders.o_totalprice.sum()) and ksum.min() < 5
    half = 1 / np.sqrt(ksum)
    want = np.sort(np.linalg.eigvalsh(half[:, None] * total * half[None, :]))[::-1][:4]
    got = [r.eigenvalue for r in queries.QUERIES["incomplete_eig_wide"](spark, sf).orderBy("comp").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_blocks_of_features_give_the_same_neighbours(spark):
    import random

    from concord.operators import prep

    rnd = random.Random(2)
    rows = [(f"f{i:02d}", f"s{j}", None if rnd.random() < 0.2 else float(rnd.randint(0, 5))) for i in range(30) for j in range(6)]
    values = spark.createDataFrame(rows, "feature string, sample string, value double")
    got = [sorted(map(tuple, prep.knn_impute(values, 3, block_rows=n).collect())) for n in (4096, 7, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


def test_many_ranges_meet_in_bins(spark, monkeypatch):
    from concord.operators import prep

    features = spark.createDataFrame([(str(n), float(n)) for n in range(-50, 400)], "feature string, coord double")
    wanted = prep.ranges(spark, ["a:3-9", "b:100-100", "c:390-1000", "d:42-47", "e:9-12"])
    few = sorted(r.feature for r in prep.point_filter(features, wanted, match_chrom=False).collect())
    monkeypatch.setattr(prep, "FEW_RANGES", 2)
    assert sorted(r.feature for r in prep.point_filter(features, wanted, match_chrom=False).collect()) == few and len(few) == 27


def test_scattered_cells(spark):
    from concord.operators import moments

    cells = spark.createDataFrame([("a", 2, 1.0), ("a", 0, None), ("b", 1, 3.0)], "k string, pos int, value double")
    assert {r.k: r.x for r in moments.scattered(cells, "k", 3, None).collect()} == {"a": [None, None, 1.0], "b": [None, 3.0, None]}
    assert {r.k: r.x for r in moments.scattered(cells.where("value is not null"), "k", 3, 0.0).collect()} == {"a": [0.0, 0.0, 1.0], "b": [0.0, 3.0, 0.0]}


def test_colours_of_variables(spark, sf):
    from concord.operators import select
    from concord.plans import fit, queries

    result = fit.fit_incomplete(queries.status_blocks(spark, sf))
    with pytest.raises(ValueError, match="as many colors"):
        select.plot_variables(result, ["price"], var_col=["red", "blue"])
    with pytest.raises(ValueError, match="no color"):
        select.plot_variables(result, ["price"], var_col={"f": "red"})
    rows = select.plot_variables(result, ["price"], var_col=["green"], nlab=0, var_lab=False).collect()
    assert {(r.color, r.labelled, r.label) for r in rows} == {("green", False, None)}

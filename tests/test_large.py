"""Fits in tiles: the factorisation, the eigen solver and whole fits against dense ones."""

import numpy as np
import pytest

from concord.model import Block
from concord.operators import tiles
from concord.plans import fit as fits
from concord.plans import large
from concord.plans.solve import cholesky
from tests.test_fit import dense, random_tables, same_up_to_sign


def packed(spark, ids, x):
    return Block.packed(spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, x)], "id string, x array<double>").repartition(3), [f"v{k}" for k in range(x.shape[1])])


def assembled(frame, width, tile, t=0):
    out = np.zeros((width, width))
    for r in frame.where(f"t = {t}").collect():
        a, c = r.i * tile, r.j * tile
        rows = min(tile, width - a)
        x = np.frombuffer(r.data).reshape(rows, -1)
        out[a : a + rows, c : c + x.shape[1]] = x
    return out


@pytest.mark.parametrize(("widths", "tile"), [([5], 8), ([9, 8, 2], 4)])
def test_tiled_products_factor_and_apply(spark, widths, tile):
    rng = np.random.default_rng(sum(widths))
    x = rng.normal(size=(60, sum(widths)))
    rows = spark.createDataFrame([(x[k : k + 4].tobytes(),) for k in range(0, 60, 4)], "data binary").repartition(7)

    def matrices(batch):
        return (np.frombuffer(d).reshape(-1, sum(widths)) for d in batch.column("data").to_pylist())

    starts = np.concatenate([[0], np.cumsum(widths)])
    lam = [0.5 * n for n in range(len(widths))]
    for pass_bytes in (256 << 20, 8 * tile * tile * 2):  # all tiles in one pass, and two at a time
        products = tiles.product_tiles(rows, widths, matrices, tile, pass_bytes)
        for t, (a, b) in enumerate(zip(starts, starts[1:])):
            assert np.allclose(assembled(products, b - a, tile, t), np.tril(x[:, a:b].T @ x[:, a:b]) + np.triu(assembled(products, b - a, tile, t), 1))
        factor = tiles.inverse_factor(products, widths, lam, lambda m, t, k: cholesky(m, str(t)), tile)
        v = rng.normal(size=(sum(widths), 2))
        down, up = tiles.apply(factor, widths, v, False, tile), tiles.apply(factor, widths, v, True, tile)
        for t, (a, b) in enumerate(zip(starts, starts[1:])):
            inverse = np.linalg.inv(np.linalg.cholesky(x[:, a:b].T @ x[:, a:b] + lam[t] * np.eye(b - a)))
            assert np.allclose(assembled(factor, b - a, tile, t), inverse, atol=1e-10)
            assert np.allclose(down[a:b], inverse @ v[a:b]) and np.allclose(up[a:b], inverse.T @ v[a:b])


def test_factor_names_the_dependent_table(spark):
    x = np.random.default_rng(1).normal(size=(30, 6))
    x[:, 5] = x[:, 0] + x[:, 1]
    rows = spark.createDataFrame([(x.tobytes(),)], "data binary")
    products = tiles.product_tiles(rows, [2, 4], lambda b: (np.frombuffer(d).reshape(-1, 6)[:, [2, 3, 0, 1, 4, 5]] for d in b.column("data").to_pylist()), 2)
    with pytest.raises(ValueError, match="table second"):
        tiles.inverse_factor(products, [2, 4], [0.0, 0.0], lambda m, t, k: cholesky(m, ("first", "second")[t], np.full(len(m), 30.0)), 2)


@pytest.mark.parametrize("kind", ["spread", "repeated", "low rank", "close", "small"])
def test_lanczos_equals_the_library(kind):
    rng = np.random.default_rng(3)
    n = 4 if kind == "small" else 300
    values = {"spread": np.linspace(0, 1, n) ** 3, "repeated": np.repeat([1.0, 0.9, 0.1], n // 3), "low rank": np.r_[[2.0, 1.0], np.zeros(n - 2)], "close": 1 - 1e-3 * np.arange(n) / n, "small": np.arange(4.0)}[kind]
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    m = (q * values) @ q.T
    found, vectors, _ = large.lanczos(lambda v: m @ v, n, 3, basis=40)
    want = np.sort(values)[::-1][:3]
    assert np.allclose(found, want, atol=1e-9)
    assert np.allclose(m @ vectors, vectors * found, atol=1e-8) and np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-10)
    with pytest.raises(ValueError, match="settle"):
        large.lanczos(lambda v: np.diag(np.linspace(0.999, 1, 500)) @ v, 500, 3, most=2)


@pytest.mark.parametrize(("widths", "lam", "scale", "present"), [((13, 22, 9), None, True, 0.8), ((20, 21), [0.5, 30.0], True, 0.9), ((12, 6), None, False, 1)])
def test_iterative_fit_equals_dense(spark, monkeypatch, widths, lam, scale, present):
    monkeypatch.setattr(large, "TILE", 8)
    monkeypatch.setattr(large, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(large.solve_large, "__defaults__", (8,))
    tables = random_tables(np.random.default_rng(sum(widths)), widths, 70, present)
    want = dense(tables, 3, lam, scale)
    blocks = {f"t{n}": packed(spark, *t) for n, t in enumerate(tables)}
    options = {"nfac": 3, "scores": True, "method": "penalized" if lam else "solve", "lam": lam, "scale": scale}
    one = fits.fit_incomplete(blocks, solver="iterative", **options)
    two = fits.fit_incomplete(blocks, solver="dense", **options)
    assert np.allclose(one.eigenvalues, want["values"], atol=1e-9) and np.allclose(one.eigenvalues, two.eigenvalues, atol=1e-9)
    comps = ["comp1", "comp2", "comp3"]
    a, b = ({r.id: [r[c] for c in comps] for r in f.y.collect()} for f in (one, two))
    assert np.allclose([a[i] for i in want["ids"]], [b[i] for i in want["ids"]], atol=1e-8)  # signs too
    same_up_to_sign(np.array([a[i] for i in want["ids"]]), want["y"])
    for frames in ("cors", "p_values", "ave_x", "ave_outer", "scores"):
        left, right = (sorted(tuple(r) for r in getattr(f, frames).collect()) for f in (one, two))
        assert len(left) == len(right) and all(u[:-1] == v[:-1] or frames == "scores" for u, v in zip(left, right))
        assert np.allclose([[x for x in r if isinstance(x, float)] for r in left], [[x for x in r if isinstance(x, float)] for r in right], atol=1e-7)
    one.release()
    two.release()


def test_iterative_complete_fit_and_constants(spark, monkeypatch):
    monkeypatch.setattr(large.solve_large, "__defaults__", (5,))
    tables = random_tables(np.random.default_rng(4), (11, 7), 40, 1)
    blocks = {f"t{n}": packed(spark, *t) for n, t in enumerate(tables)}
    plain = fits.fit_complete(blocks, nfac=2)
    more = {f"t{n}": packed(spark, ids, np.insert(x, 2, 7.0, axis=1)) for n, (ids, x) in enumerate(tables)}
    for solver in ("dense", "iterative"):
        with pytest.raises(ValueError, match="v2 is constant"):
            fits.fit(more, missing="forbid", solver=solver)
        got = fits.fit(more, missing="forbid", solver=solver, constant="drop")
        assert np.allclose(got.eigenvalues, plain.eigenvalues)
        assert {r.variable for r in got.cors.where("table = 't1'").collect()} == {f"v{k}" for k in range(8)} - {"v2"}
        assert np.allclose(sorted(r.r for r in got.cors.collect()), sorted(r.r for r in plain.cors.collect()), atol=1e-8)
    with pytest.raises(ValueError, match="missing values in v1"):
        fits.fit({"a": packed(spark, list("abcdef"), np.array([[1.0, np.nan]] * 3 + [[2.0, 1.0]] * 3)), "b": blocks["t0"]}, solver="iterative")
    with pytest.raises(ValueError, match="solver"):
        fits.fit(blocks, solver="x")
    with pytest.raises(ValueError, match="several rows"):
        fits.fit({"a": packed(spark, ["a", "a", "b"], np.eye(3)), "b": blocks["t0"]}, solver="iterative")


def test_more_variables_than_the_driver_takes(spark, monkeypatch):
    """The limit only chooses the solver."""
    monkeypatch.setattr(fits, "DRIVER_LIMIT", 10)
    monkeypatch.setattr(large.solve_large, "__defaults__", (6,))
    tables = random_tables(np.random.default_rng(6), (9, 8), 60, 0.9)
    got = fits.fit_incomplete({f"t{n}": packed(spark, *t) for n, t in enumerate(tables)}, nfac=2)
    assert np.allclose(got.eigenvalues, dense(tables, 2)["values"], atol=1e-9) and got.cached.shared_folder


def test_many_variables_query(spark, sf):
    """Against matrices of individuals; the hash is Spark's."""
    import re
    from collections import Counter

    from concord.plans import queries

    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    said = {role: {} for role in ("user", "assistant")}
    for r in rows:
        words = [w for w in re.split("[^a-z]+", r.text.lower()) if w]
        if r.role in said and words:
            said[r.role].setdefault(str(r.conv_id), Counter()).update(words)
    vocabulary = sorted({w for own in said.values() for c in own.values() for w in c})
    places = {r.word: r.pos for r in spark.createDataFrame([(w,) for w in vocabulary], "word string").selectExpr("word", f"pmod(xxhash64(word), {queries.BUCKETS}) pos").collect()}
    tables = []
    for own in said.values():
        ids = sorted(own)
        x = np.zeros((len(ids), queries.BUCKETS))
        for n, i in enumerate(ids):
            for w, c in own[i].items():
                x[n, places[w]] += c
        tables.append((ids, x[:, x.std(axis=0) > 0]))
    want = dense(tables, 2, [20_000.0, 20_000.0])["values"]
    got = [r.eigenvalue for r in queries.QUERIES["many_variables_eig"](spark, sf).orderBy("comp").collect()]
    assert np.allclose(got, want, atol=1e-6)

"""Leave-one-out fits by updates, against refits of every row."""

import numpy as np
import pytest

from concord.plans import tune
from concord.plans.downdate import whole


def scores(seed, m, widths, common, spikes=0):
    rng = np.random.default_rng(seed)
    p = sum(widths)
    x = rng.normal(size=(m, p)) + rng.normal(size=(m, common)) @ rng.normal(size=(common, p))
    x[:spikes] *= 40
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def refits(x, widths, lam, nfac):
    """Each fit anew, from rows that lack one."""
    out = []
    for k in range(len(x)):
        rest = np.delete(x, k, 0)
        z = (rest - rest.mean(axis=0)) / rest.std(axis=0, ddof=1)
        out.append(tune.ave_outer((z.T @ z)[None], widths, lam, nfac)[0])
    return np.array(out)


@pytest.mark.parametrize("m, widths, common, nfac", [(200, [12, 15], 2, 2), (120, [20, 10, 15], 3, 3), (300, [24, 24], 0, 1)])
@pytest.mark.parametrize("lam", [0.0, 0.75, 60.0])
def test_updates_equal_refits(m, widths, common, nfac, lam):
    x = scores(1, m, widths, common)
    got, proven = whole(x.T @ x, widths, [lam] * len(widths), nfac, m).score(x)
    assert proven.mean() > 0.5
    assert np.allclose(got[proven], refits(x, widths, [lam] * len(widths), nfac)[proven], rtol=1e-8, atol=1e-10)


def test_rows_that_change_the_order_are_not_taken_as_proven():
    """A few rows of forty times the size make pairs of their own, which go with them."""
    x = scores(2, 150, [10, 10], 1, spikes=2)
    got, proven = whole(x.T @ x, [10, 10], [0.5, 0.5], 2, 150).score(x)
    want = refits(x, [10, 10], [0.5, 0.5], 2)
    assert np.allclose(got[proven], want[proven], rtol=1e-8, atol=1e-10) and not proven[:2].any()


def test_equal_columns_and_ties():
    x = scores(3, 80, [10, 10], 2)
    x[:, 11] = x[:, 10]
    got, proven = whole(x.T @ x, [10, 10], [1.0, 1.0], 2, 80).score(x)
    assert np.allclose(got[proven], refits(x, [10, 10], [1.0, 1.0], 2)[proven], rtol=1e-8, atol=1e-10)
    x[40:] = x[:40]  # repeated rows
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    got, proven = whole(x.T @ x, [10, 10], [1.0, 1.0], 2, 80).score(x)
    assert np.allclose(got[proven], refits(x, [10, 10], [1.0, 1.0], 2)[proven], rtol=1e-8, atol=1e-10)


def test_grid_by_updates_and_dense(spark):
    x = scores(4, 90, [12, 14], 2, spikes=1)
    frames = [spark.createDataFrame([(f"i{k}", *map(float, r)) for k, r in enumerate(part)], "id string, " + ", ".join(f"v{j} double" for j in range(part.shape[1]))) for part in (x[:, :12], x[:, 12:])]
    args = (*frames, [0.0, 0.5], [0.5, 30.0])
    best, got = tune.leave_one_out_grid(*args, solver="updates")
    wanted, want = tune.leave_one_out_grid(*args, solver="dense")
    assert best == wanted
    assert np.allclose(*([r.mean_ave for r in f.orderBy("lambda1", "lambda2").collect()] for f in (got, want)), rtol=1e-9)
    assert {(r.lambda1, r.lambda2): r.mean_ave for r in got.collect()}[0.5, 30.0] == pytest.approx(refits(x, [12, 14], [0.5, 30.0], 2).mean())
    with pytest.raises(ValueError, match="solver"):
        tune.leave_one_out_grid(*args, solver="other")


def test_query_of_embeddings(spark, sf):
    import pandas as pd

    from concord.plans import queries

    e = np.stack(pd.read_parquet(f"{sf}/embeddings.parquet").embedding).astype(np.float32).astype(float)
    z = (e - e.mean(axis=0)) / e.std(axis=0, ddof=1)
    got = {(r.lambda1, r.lambda2): r.mean_ave for r in queries.QUERIES["loo_cv_embeddings"](spark, sf).collect()}
    assert len(got) == 4
    for (a, b), v in got.items():
        assert v == pytest.approx(refits(z, [32, 32], [a, b], 2).mean(), abs=2e-6)

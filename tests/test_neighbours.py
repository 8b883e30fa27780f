"""Nearest features: bounds hold, blocks that cannot hold a neighbour are left out, results are those of all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.operators import neighbours, prep


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 7), st.integers(1, 9), st.floats(0, 0.9))
def test_bounds_hold_for_partial_distances(seed, width, size, holes):
    rnd = np.random.default_rng(seed)
    block = np.where(rnd.random((size, width)) < holes, np.nan, rnd.integers(-4, 9, (size, width)).astype(float))
    values = np.where(rnd.random((5, width)) < holes, np.nan, rnd.integers(-9, 5, (5, width)).astype(float))
    known = ~np.isnan(block)
    low = np.array([np.nanmin(c) if (~np.isnan(c)).any() else np.nan for c in block.T])
    high = np.array([np.nanmax(c) if (~np.isnan(c)).any() else np.nan for c in block.T])
    bound = neighbours.least_distances(values, low, high, known.all(0), int(known.sum(1).min()))
    for row, least in zip(values, bound):
        for other in block:
            both = ~np.isnan(row) & ~np.isnan(other)
            if both.any():
                assert least <= ((row - other)[both] ** 2).mean() + 1e-9


def test_two_means_gives_every_leaf_a_number_and_separates_clusters():
    rnd = np.random.default_rng(1)
    rows = np.repeat(rnd.normal(0, 20, (6, 4)), 30, axis=0) + rnd.normal(0, 0.1, (180, 4))
    tree = neighbours.two_means(rows, 6)
    leaves = tree.leaves(rows)
    assert set(leaves) == set(range(6)) and all(len(set(leaves[n : n + 30])) == 1 for n in range(0, 180, 30))
    assert set(neighbours.two_means(np.ones((9, 3)), 4).leaves(np.ones((9, 3)))) == {0}  # equal rows cannot be told apart
    hole = neighbours.two_means(np.full((3, 2), np.nan), 2)
    assert set(hole.leaves(np.full((3, 2), np.nan))) == {0}


def clustered(seed, clusters, size, width, holes):
    rnd = np.random.default_rng(seed)
    rows = np.repeat(rnd.normal(0, 50, (clusters, width)), size, axis=0) + rnd.normal(0, 1, (clusters * size, width))
    rows[rnd.random(rows.shape) < holes] = np.nan
    return [(f"f{n:04d}", f"s{j}", None if np.isnan(v) else float(v)) for n, row in enumerate(rows) for j, v in enumerate(row)]


def brute(cells, k):
    names, samples = sorted({f for f, _, _ in cells}), sorted({s for _, s, _ in cells})
    x = np.full((len(names), len(samples)), np.nan)
    for f, s, v in cells:
        x[names.index(f), samples.index(s)] = np.nan if v is None else v
    out = {}
    for n in range(len(names)):
        for j in np.flatnonzero(np.isnan(x[n])).tolist() if np.isnan(x[n]).mean() <= 0.5 else ():
            near = []
            for m in range(len(names)):
                both = ~np.isnan(x[n]) & ~np.isnan(x[m])
                if m != n and both.any() and not np.isnan(x[m, j]):
                    near.append((((x[n] - x[m])[both] ** 2).mean(), names[m]))
            out[names[n], j] = [m for _, m in sorted(near)[:k]]
    return out


@pytest.mark.parametrize(("holes", "block", "chunk"), [(0.05, 16, 1 << 20), (0.3, 10, 400)])
def test_search_equals_all_pairs_and_leaves_blocks_out(spark, holes, block, chunk, monkeypatch):
    cells = clustered(3, 8, 20, 6, holes)
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", chunk)
    frame = spark.createDataFrame(cells, "feature string, sample string, value double")
    _, near = prep.knn_search(frame, k=4, block_rows=block)
    got: dict = {}
    for r in near.found.orderBy("id", "pos", "distance", "neighbour").collect():
        got.setdefault((r["id"], r.pos), []).append(r.neighbour)
    want = brute(cells, 4)
    assert got == {c: n for c, n in want.items() if n}
    asked = near.asked.collect()
    assert near.blocks > 8 and len(asked) == len({(r.home, r.block) for r in asked})
    if holes < 0.1:
        assert len(asked) < near.blocks**2 / 2  # clusters do not meet
    near.release()


def test_hot_group_of_equal_features_and_empty_ones(spark):
    """A third of all features are equal, one has no value, names tie."""
    cells = [(f"e{n:03d}", f"s{j}", None if (n, j) == (0, 1) else 1.0) for n in range(60) for j in range(3)]
    cells += [(f"x{n:03d}", f"s{j}", float(n + j)) for n in range(120) for j in range(3)] + [("none", f"s{j}", None) for j in range(3)]
    frame = spark.createDataFrame(cells, "feature string, sample string, value double")
    filled, near = prep.knn_search(frame, k=2, block_rows=8)
    rows = {(r.feature, r["sample"]): r.value for r in filled.collect()}
    assert len(rows) == len(cells) and rows["e000", "s1"] == 1.0 and not any(v is None for v in rows.values())
    assert [r.neighbour for r in near.found.orderBy("distance", "neighbour").collect()] == ["e001", "e002"]


def test_copies_are_searched_once_and_count_as_often_as_there_are(spark):
    """Each feature up to nine times, their names far apart: neighbours of all are those of all pairs, blocks those of the distinct ones."""
    base, names = clustered(7, 5, 6, 5, 0.2), {}
    for f, s, v in base:
        names.setdefault(f, {})[s] = v
    copies = [(f"c{c}{f}", s, v) for n, (f, row) in enumerate(names.items()) for c in range(1 + (n * 7) % 9) for s, v in row.items()]
    search = lambda cells: prep.knn_search(spark.createDataFrame(cells, "feature string, sample string, value double"), k=4, block_rows=5)[1]
    once, near = search(base), search(copies)
    got: dict = {}
    for r in near.found.orderBy("id", "pos", "distance", "neighbour").collect():
        got.setdefault((r["id"], r.pos), []).append(r.neighbour)
    want = brute(copies, 4)
    assert got == {c: n for c, n in want.items() if n}
    assert near.blocks <= 2 * once.blocks and near.members.count() == len(copies) // 5
    asking = sum(r.queries for r in near.asked.where("home = block").collect())
    assert asking == len({f for f, _ in want})
    once.release(), near.release()


def test_what_meets_is_not_shuffled(spark):
    """Features without clusters, nearly all of which ask nearly all blocks: less is shuffled than a tenth of a row for each such pair."""
    rnd = np.random.default_rng(4)
    rows = np.where(rnd.random((1500, 5)) < 0.2, np.nan, rnd.random((1500, 5)))
    frame = spark.createDataFrame([(f"f{n:04d}", f"s{j}", None if np.isnan(v) else float(v)) for n, row in enumerate(rows) for j, v in enumerate(row)], "feature string, sample string, value double")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    _, near = prep.knn_search(frame, k=3, block_rows=4)
    found = near.found.collect()
    took, searches = shuffled() - before, sum(r.queries for r in near.asked.collect())
    assert len({(r["id"], r.pos) for r in found}) == int(np.isnan(rows[np.isnan(rows).sum(1) <= 2]).sum()) and searches > 50_000
    assert took < searches * 10
    near.release()

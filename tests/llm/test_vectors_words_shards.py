"""Whitening, spelling variants and sharding against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import interleave, queries, spelling, whiten

# ---------------------------------------------------------------- whitening


def symmetric(kind, n, rnd):
    if kind == "random":
        a = rnd.normal(size=(n, n))
        return a @ a.T
    if kind == "repeated":  # a few values many times over
        q, _ = np.linalg.qr(rnd.normal(size=(n, n)))
        return (q * np.repeat([5.0, 3.0, 1.0], -(-n // 3))[:n]) @ q.T
    if kind == "close":
        q, _ = np.linalg.qr(rnd.normal(size=(n, n)))
        return (q * (7 + 1e-9 * np.arange(n))) @ q.T
    if kind == "diagonal":
        return np.diag(rnd.integers(0, 4, n).astype(float))
    if kind == "identity":
        return np.eye(n) * 3
    if kind == "low rank":
        a = rnd.normal(size=(n, 2))
        return a @ a.T
    return np.diag(10.0 ** -np.arange(n)) + 1e-14


@pytest.mark.parametrize("kind", ["random", "repeated", "close", "diagonal", "identity", "low rank", "graded"])
@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_leading_pairs_equal_the_library(kind, n):
    m = symmetric(kind, n, np.random.default_rng(n))
    m = (m + m.T) / 2
    values, vectors = whiten.leading_pairs(m, 5)
    want = np.linalg.eigvalsh(m)[::-1][:5]
    if not np.abs(m).max() > 0:
        assert not len(values)
        return
    norm = np.abs(want).max()
    assert np.allclose(values, want, atol=1e-13 * norm * n)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(m @ vectors - vectors * values).max() < 2e-13 * norm * n


def brute_whitening(rows, k):
    usable = [(i, [int(np.floor(256 * float(np.float32(v)))) for v in x]) for i, x in rows if x is not None and all(v is not None and np.isfinite(np.float32(v)) for v in x)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), np.array(distinct).sum(axis=0)
    centred = np.array(distinct) - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in usable:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        out.setdefault(i, []).append((deviation, (np.array(x) - sums / n) @ vectors / np.sqrt(values)))
    return n, values, values / np.trace(v), out


def test_whitening_equals_brute_force(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(70, 3)) @ rnd.normal(size=(3, 6)) + 0.2 * rnd.normal(size=(70, 6))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (3, rows[3][1]), (None, rows[5][1]), (902, None), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [float("nan")] * 6), (905, [float("inf"), *[0.0] * 5]), (906, [3e38, *[0.0] * 5]), (907, [-0.0] * 6)]
    frame = spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "vec_id bigint, embedding array<float>, id int, c string").repartition(5)
    model = whiten.fit(frame)
    n, values, explained, want = brute_whitening([r for r in rows if r[0] != 906], 4)
    assert model.n == n and np.allclose(model.values, values, rtol=1e-12) and model.identity_error < 1e-10
    got = collections.defaultdict(dict)
    sign = None
    found = whiten.components_of(frame, model).collect()
    assert len(found) == 4 * sum(map(len, want.values()))
    for r in found:
        got[r.id].setdefault(r.component, []).append((r.deviation, r.whitened))
        assert r.n == n and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error == model.identity_error
    sign = [np.sign(got[0][c + 1][0][1] * want[0][0][1][c]) for c in range(4)]
    assert got.keys() == want.keys()
    for i, parts in want.items():
        for c in range(4):
            assert sorted(d for d, _ in got[i][c + 1]) == sorted(d for d, _ in parts)
            assert np.allclose(sorted(sign[c] * w for _, w in got[i][c + 1]), sorted(w[c] for _, w in parts), atol=1e-9)


def test_whitening_without_variance_or_rows(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        frame = spark.createDataFrame(rows, kind)
        assert whiten.components_of(frame, whiten.fit(frame)).collect() == []
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [2.0, 2.0])], kind)  # one dimension that varies
    got = sorted((r.id, r.component, round(abs(r.whitened), 9), r.explained) for r in whiten.components_of(frame, whiten.fit(frame)).collect())
    assert got == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0)]
    with pytest.raises(Exception, match="number of values"):
        whiten.fit(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0])], kind))


def test_deviations_are_exact_and_null_where_too_large():
    x = np.array([[2**40, -5], [0, 3]])
    sums = np.array([2**40, -2], dtype=object)
    assert whiten._deviation(x, 2, sums) == [None, None]
    small = np.array([[7, -5], [0, 3]])
    assert whiten._deviation(small, 2, np.array([7, -2], dtype=object)) == [49 + 64, 49 + 64]


def test_whitening_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, values, explained, want = brute_whitening([(r.vec_id, r.embedding) for r in rows], 4)
    found = queries.op11_whitening(spark, sf).collect()
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {n}
    got = {(r.vec_id, r.component): r for r in found}
    for c in range(4):
        a = np.array([got[r.vec_id, c + 1].whitened for r in rows])
        b = np.array([want[r.vec_id][0][1][c] for r in rows])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert all(got[r.vec_id, 1].deviation == want[r.vec_id][0][0] for r in rows)


# ---------------------------------------------------------------- spelling


def brute_words(docs, rules):
    total = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % rules.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= rules.shortest:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= rules.least}


def edits(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_group(vocabulary, ratio):
    out = {}
    for w, n in vocabulary.items():
        near = [v for v in vocabulary if abs(len(v) - len(w)) < 2 and edits(v, w)]
        best = min(near, key=lambda v: (-vocabulary[v], v)) if near else None
        out[w] = (n, len(near), best if near and vocabulary[best] >= ratio * n else None)
    rows = []
    for w, (n, count, form) in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        rows.append((w, n, count, form, None if form is None else vocabulary[form], root))
    return sorted(rows, key=str)


def typo(rnd, w, letters):
    k = rnd.randrange(len(w))
    return rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]])


@pytest.mark.parametrize(("letters", "rules"), [("abcdeé", {}), ("abcdefghijklmnopqrstuvwxyzàÿ÷", {"block_words": 3}), ("abé", {"classes": 2, "block_words": 5, "ratio": 3}), ("aeqz", {"classes": 1, "least": 1})])
def test_groups_equal_brute_force(spark, letters, rules):
    rnd = random.Random(4)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 10))) for _ in range(25)]
    docs = []
    for i in range(60):
        chosen = [rnd.choice(base[: 2 + i % 20]) for _ in range(40)]
        chosen += [typo(rnd, w, letters) for w in chosen[:4]] + [typo(rnd, typo(rnd, chosen[0], letters), letters)] * 2
        docs.append((i, rnd.choice([" ", ", ", "1", "_"]).join(c.upper() if rnd.random() < 0.1 else c for c in chosen)))
    docs += [docs[0], docs[1], (None, docs[2][1]), (90, None), (91, ""), (92, "short it is"), (93, ("q" * 3000 + " ") * 2 + "q" * 3001 + " " + "q" * 3001), (94, "É" * 8 + " " + "é" * 8), (95, ("ab " * 40_000) + base[0])]
    rules = spelling.Rules(**rules)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n int, word string").repartition(3)
    got = sorted(map(tuple, spelling.group(frame, rules).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)
    assert got == brute_group(brute_words(docs, rules), rules.ratio)


def test_roots_follow_long_chains(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000}
    frame = spark.createDataFrame([(n, " ".join([w] * c)) for n, (w, c) in enumerate(chain.items())], "doc_id bigint, text string")
    rules = spelling.Rules(noise=0)
    got = {r.word: (r.form, r.root) for r in spelling.group(frame, rules).collect()}
    assert got == {"abcdefg": ("abcdefgh", "abcdefghij"), "abcdefgh": ("abcdefghi", "abcdefghij"), "abcdefghi": ("abcdefghij", "abcdefghij"), "abcdefghij": (None, "abcdefghij")}
    assert spelling.group(frame.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcé\U0001d51e", min_size=1, max_size=6), min_size=1, max_size=12, unique=True), st.lists(st.text("abcé\U0001d51e", min_size=1, max_size=6), min_size=1, max_size=12, unique=True))
def test_products_find_every_edit(xs, ys):
    a, b = spelling.Letters(xs), spelling.Letters(ys)
    i, j = spelling.close(a, b)
    good = spelling.one_edit(a, b, i, j)
    found = set(zip(i[good].tolist(), j[good].tolist()))
    assert found == {(m, n) for m, x in enumerate(xs) for n, y in enumerate(ys) if edits(x, y)}


def test_adjacent_blocks_cover_every_edit():
    rnd = random.Random(1)
    reach = set(spelling.steps(6)) | {tuple(-v for v in s) for s in spelling.steps(6)} | {(0,) * 6}
    own = spelling.letter_classes(6)

    def block(w):
        counts = [sum(c in letters for c in w) for letters in own]
        return (*counts, len(w) - sum(counts))

    for _ in range(2000):
        w = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüß") for _ in range(9))
        assert tuple(x - y for x, y in zip(block(w), block(typo(rnd, w, "abcxyzéß")))) in reach


# ---------------------------------------------------------------- sharding


def checked_shards(found, rows, shards):
    """Laws that hold whatever the order: one row each, even counts, slots without gaps."""
    crc = lambda t: zlib.crc32((t or "").encode())
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((r.id, r.source, r.size, r.text_crc32) for r in found) == collections.Counter((i, s, size(t), crc(t)) for i, t, s in rows)
    assert sorted(r.position for r in found) == list(range(len(rows)))
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r.position):
        by[r.shard].append(r.slot)
    assert all(slots == list(range(len(slots))) for slots in by.values())
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    # every prefix of the interleaving has the mixture: within one row of each source, and the shift of all others
    totals = collections.Counter(s for _, _, s in rows)
    seen = collections.Counter()
    for k, r in enumerate(sorted(found, key=lambda r: r.position), 1):
        seen[r.source] += 1
        for s, n in totals.items():
            assert abs(seen[s] - n * k / len(rows)) <= 1 + len(totals) / 2


@pytest.mark.parametrize(("count", "bucket_rows"), [(0, 10), (1, 10), (5, 10), (400, 10), (400, 100_000)])
def test_shards_keep_the_mixture(spark, count, bucket_rows):
    rnd = random.Random(count)
    rows = [(n, "é" * rnd.randint(0, 40), rnd.choice(["a", "a", "a", "b", "c", None, ""])) for n in range(count)]
    if count == 400:
        rows += [(7, "same", "a")] * 250 + [(None, None, "b"), (None, "", None), (401, "w " * 60_000, "d")]
    frame = spark.createDataFrame([(i, t, s, 1, "p") for i, t, s in rows], "doc_id bigint, text string, source string, id int, position string").repartition(3)
    found = interleave.assign(frame, shards=8, bucket_rows=bucket_rows).collect()
    checked_shards(found, rows, 8)
    again = interleave.assign(frame.repartition(5), shards=8, bucket_rows=bucket_rows).collect()  # the seed alone decides
    assert sorted(map(str, found)) == sorted(map(str, again))
    if count == 400:
        other = interleave.assign(frame, shards=8, seed=3, bucket_rows=bucket_rows).collect()
        assert sorted(map(str, found)) != sorted(map(str, other))


def test_copies_are_expanded_in_runs(spark, monkeypatch):
    monkeypatch.setattr(interleave, "RUN", 7)
    rows = [(1, "x", "a")] * 100 + [(n, "y", "b") for n in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    checked_shards(interleave.assign(frame, shards=3).collect(), rows, 3)


def test_written_shards(spark, tmp_path):
    rows = [(n, f"t{n}", "ab"[n % 2], n * 0.5) for n in range(50)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size double")
    interleave.write_shards(frame, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.text, r.source, r["size"]) for r in back) == rows
    want = {r.id: (r.shard, r.slot) for r in interleave.assign(frame, shards=4).collect()}
    assert all(want[r.doc_id] == (r._shard, r._slot) for r in back)


def test_sharding_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = queries.op13_sharding(spark, sf).collect()
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in found) == sorted((d.doc_id, len(d.text.encode()) + 1, zlib.crc32(d.text.encode())) for d in docs)
    mixture = collections.Counter(d.source for d in docs)
    for k in range(8):
        own = collections.Counter(r.source for r in found if r.shard == k)
        assert all(abs(own[s] - n / 8) <= 1 + len(mixture) / 2 for s, n in mixture.items())

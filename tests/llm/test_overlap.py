"""The Jaccard join and benchmark decontamination against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from concord.llm import decontam, jaccard


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, least, per):
    """(id, size, component) of every row, comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None:
                both = len(x & y)
                if per * both >= least * (len(x) + len(y) - both):
                    p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                    root[q] = p
    return sorted((str(i), len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets))


def family(rnd, words, count, base, most):
    """Copies of one text with up to ``most`` words changed."""
    text = [rnd.choice(words) for _ in range(base)]
    out = []
    for _ in range(count):
        copy = list(text)
        for _ in range(rnd.randint(0, most)):
            copy[rnd.randrange(base)] = rnd.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["w%d" % n for n in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(120)]
    texts += family(rnd, words, 90, 60, 6) + family(rnd, words, 60, 150, 9) + family(rnd, words, 25, 9, 1) + [texts[3]] * 30
    passage = " ".join(rnd.choice(words) for _ in range(55))
    texts += [f"{' '.join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))} {passage}" for _ in range(40)]
    out = list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, " \t\n"), (None, texts[0]), (9003, "Two Words"), (9004, "two\x0bWORDS"), (9005, "É two"), (9006, "é two")]
    out += [(5, texts[5]), (5, "another text for the same id here " * 2), (9007, "another text for the same id here " * 2), (9008, "same " * 5000), (9009, "same " * 6000)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "least", "limits"), [(4, 85, {}), (5, 80, {"cell_shingles": 2000, "cell_work": 20_000, "pivots": 4, "cell_pivots": 4}), (2, 60, {"cell_shingles": 600, "cell_work": 9_000, "pivots": 3, "cell_pivots": 3, "group": 6}), (3, 100, {"group": 4}), (4, 85, {"pivots": 0, "group": 1})])
def test_join_equals_brute_force(spark, rows, k, least, limits):
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id bigint, text string, n int, region string")
    got = jaccard.similar(docs, jaccard.Join(words=k, least=least, per=100, **limits)).collect()
    assert sorted((str(r.id), r.n_shingles, r.component_id) for r in got) == brute(rows, k, least, 100)


def test_windows_lose_no_link(rows):
    """Every linked pair shares a cell, whatever the pivots; windows leave others out."""
    join, rnd = jaccard.Join(words=2, least=70), random.Random(3)
    sets = [s for s in jaccard.Shingler(2)([t for _, t in rows]) if len(s)]
    for most in (1, 5, 40):
        chosen = jaccard.net(rnd.sample(sets, 120), most, join)
        drawn = [sets[k] for k in chosen]
        pivots = jaccard.Pivots(drawn, join)
        inside = pivots.windows(sets)
        home = pivots.cells(sets)[0]
        for a in range(0, len(sets), 3):
            both = jaccard.intersections(sets[a], sets)
            for b in np.flatnonzero(100 * both >= 70 * (len(sets[a]) + np.array([len(s) for s in sets]) - both)).tolist():
                assert home[a] in inside[b] and home[b] in inside[a]
    assert min(map(len, inside)) == 1


def test_empty_table(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id bigint, text string"), jaccard.Join()).collect() == []
    lone = spark.createDataFrame([(1, None), (2, "a")], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.similar(lone, jaccard.Join()).collect())) == [(1, 0, 1), (2, 1, 2)]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def slow_leaks(texts, items, limits):
    """The whole rule, slowly: (row, item, score, question, answer, first word) of the best window."""
    words = {i: decontam.words_of(t) for i, t in items if decontam.words_of(t)}
    df = Counter(w for x in words.values() for w in set(x))
    mean, total, out = sum(map(len, words.values())) / max(1, len(words)), len(words), []
    for row, text in enumerate(texts):
        found = decontam.words_of(text)
        for i, t in items:
            if i not in words:
                continue
            times = Counter(words[i])
            weight = {w: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for w, c in times.items()}
            stride, best = 32, None
            while stride < len(words[i]):
                stride *= 2
            question, answer = decontam.question_and_answer(t)
            for at in range(0, len(found), stride):
                window = found[at : at + 2 * stride]
                score = sum(x for w, x in weight.items() if w in window) / sum(weight.values())
                q, a = decontam.overlap(question, window, limits.question_words), decontam.overlap(answer, window, limits.answer_words)
                if score >= limits.score - 1e-9 and q >= limits.question and a >= limits.answer and (best is None or score > best[2] + 1e-12):
                    best = (row, i, score, q, a, at)
            if best:
                out.append(best)
    return sorted((r, str(i), round(s, 9), q, a, at) for r, i, s, q, a, at in out)


@pytest.mark.parametrize("limits", [decontam.Limits(), decontam.Limits(0.2, 0.0, 0.0), decontam.Limits(0.8, 0.3, 0.9, 5, 3)])
def test_search_equals_the_whole_rule(limits):
    rnd = random.Random(8)
    words = ["t%d" % n for n in range(80)]
    for size in (1, 5, 90):
        items = [(n, ". ".join(" ".join(rnd.choice(words[: rnd.choice([10, 80])]) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 3)))) for n in range(size)]
        items += [(-1, items[0][1]), (-2, None), (-3, "?!")]  # ties and items without words
        usable = [(i, t) for i, t in items if decontam.words_of(t)]
        df = Counter(w for _, t in usable for w in set(decontam.words_of(t)))
        mean = sum(len(decontam.words_of(t)) for _, t in usable) / len(usable)
        index = decontam.Index(usable, df, len(usable), mean, limits.score)
        texts = [None, "", "...", " ".join(rnd.choice(words) for _ in range(5000))]
        for _ in range(25):
            copy = decontam.words_of(rnd.choice(usable)[1])
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join([rnd.choice(words) for _ in range(rnd.randint(0, 90))] + copy + [rnd.choice(words) for _ in range(rnd.randint(0, 60))]))
        texts += texts[-3:]  # repeated rows
        got = sorted((r, str(i), round(s, 9), q, a, at) for r, i, s, q, a, at, _ in index.search(texts, limits))
        assert got == slow_leaks(texts, items, limits) and got


@pytest.mark.parametrize(("block", "wide", "entries", "postings"), [(2, 2, 40, 60), (1, 3, 1, 1), (16, 1, 1 << 16, 1 << 19)])
def test_batches_and_blocks_of_any_size_find_the_same(monkeypatch, block, wide, entries, postings):
    for name, value in (("BLOCK", block), ("WIDE", wide), ("ENTRIES", entries), ("POSTINGS", postings)):
        monkeypatch.setattr(decontam, name, value)
    test_search_equals_the_whole_rule(decontam.Limits(0.3, 0.2, 0.2))


def test_batches_are_bounded():
    group = np.repeat(np.arange(7), [3, 1, 9, 2, 2, 1, 4])
    for most in (1, 4, 5, 100):
        parts = list(decontam._batches(group, np.ones(len(group), np.int64), most))
        assert np.array_equal(np.concatenate([group[p] for p in parts]), group)
        assert all(p.stop - p.start <= most or len(set(group[p])) == 1 for p in parts)
        assert all(group[a.stop - 1] != group[b.start] for a, b in zip(parts, parts[1:]))


def test_recall_of_planted_items(sf):
    """Exact items and items with a tenth of their words changed, in the middle of other text."""
    import pyarrow.parquet as pq

    rnd = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    df = Counter(w for _, t in items for w in set(decontam.words_of(t)))
    index = decontam.Index(items, df, len(items), sum(len(decontam.words_of(t)) for _, t in items) / len(items), 0.5)
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t and len(t) > 400]
    exact, edited = [], []
    for i, t in items:
        host = rnd.choice(texts).split()
        at = rnd.randrange(len(host))
        words = t.split()
        for n in rnd.sample(range(len(words)), len(words) // 10):
            words[n] = "changed"
        exact.append(" ".join([*host[:at], t, *host[at:]]))
        edited.append(" ".join([*host[:at], *words, *host[at:]]))
    for made, least in ((exact, 1.0), (edited, 0.9)):
        hits = {(r[0], r[1]) for r in index.search(made, decontam.Limits())}
        assert sum((n, i) in hits for n, (i, _) in enumerate(items)) >= least * len(items)


def test_question_and_answer():
    assert decontam.question_and_answer("What is it? It is this.") == (["what", "is", "it"], ["it", "is", "this"])
    assert decontam.question_and_answer("one two three four five six seven eight") == (["one", "two", "three", "four", "five"], ["six", "seven", "eight"])
    assert decontam.question_and_answer("one") == (["one"], [])


def test_leaks(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    known = {r.item_id: r.text for r in items.collect()}
    clean = ["the of and to in is was " * 50, " ".join(w for t in list(known.values())[:9] for w in t.split()[:4])]
    some = list(known)[:12]
    planted = [(1000 + n, "the lead words " * 40 * (n % 3) + (known[i].upper() if n % 2 else known[i].replace(" ", "\n  ")) + " trailing words" * 30 * (n % 2), i) for n, i in enumerate(some)]
    half = [(2000 + n, " ".join(known[i].split()[: len(known[i].split()) // 3]), None) for n, i in enumerate(some)]
    rows = [(i, t) for i, t, _ in planted + half] + list(enumerate(clean)) + [(3000, None), (3001, ""), (None, known[some[0]])]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, id string, item_id int")
    extra = spark.createDataFrame([(-1, None), (-2, "..."), (-3, known[some[1]])], "item_id bigint, text string")
    want = {(i, item) for i, _, item in planted} | {(1001, -3), (None, some[0])}
    for most in (32 << 20, 400):
        index = decontam.build(items.unionByName(extra), max_index_bytes=most)
        assert (len(index) > 1) == (most == 400)
        assert {(r.id, r.item_id) for r in decontam.find_leaks(docs, index).collect()} == want
    left = decontam.clean(docs, index)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if i not in {i for i, _ in want})
    assert decontam.find_leaks(docs, decontam.build(items.limit(0))).count() == 0
    assert decontam.find_leaks(docs.limit(0), index).count() == 0


def test_leaks_in_the_data(spark, sf):
    items = {r.item_id: " ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in " ".join((r.text or "").lower().split())}
    got = {(r.id, r.item_id) for r in decontam.find_leaks(docs, decontam.build(spark.read.parquet(f"{sf}/benchmark.parquet"))).collect()}
    assert got >= want and {i for i, _ in got} == {i for i, _ in want}

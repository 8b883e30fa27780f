"""Language identification and language-model scoring against brute force."""

import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from concord.llm import langid, lm, queries


def test_mix_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64)
    assert (lm.unmix(lm.mix(x)) == x).all() and (lm.mix(lm.unmix(x)) == x).all()


def test_pack_round_trip():
    for n in (0, 1, 7, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        counts = np.arange(len(keys)) + 1
        got = lm.unpack(lm.pack(keys, counts, counts * 2))
        assert (got[0] == keys).all() and (not len(keys) or (got[1] == counts).all() and (got[2] == counts * 2).all())


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(train, texts, order):
    """The same model with dictionaries."""
    start = ("<s>",) * (order - 1)

    def grams(tokens, k):
        padded = (*start, *tokens)
        return [padded[at - k + 1 : at + 1] for at in range(order - 1, len(padded))]

    unigrams, counts = Counter(), {order: Counter()}
    for t in train:
        tokens = words(t) + [None]
        unigrams.update(tokens)
        counts[order].update(grams(tokens, order))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])  # distinct words before
    N, V = sum(unigrams.values()), len(unigrams)
    D = {k: lm.discounts([sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4)]) for k in counts}
    histories = {k: defaultdict(Counter) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            histories[k][g[:-1]][g[-1]] = c

    @functools.cache
    def p(g):
        k = len(g)
        if not k:
            return 1 / (V + 1)
        after = histories[k].get(g[:-1])
        if not after:
            return p(g[1:])
        cut = lambda c: D[k][min(c, 3) - 1]
        c = after.get(g[-1], 0)
        return (c - cut(c) if c else 0) / sum(after.values()) + sum(map(cut, after.values())) / sum(after.values()) * p(g[1:])

    out = []
    for t in texts:
        tokens = words(t) + [None]
        known = [unigrams[w] for w in tokens]
        out.append((len(tokens), sum(c > 0 for c in known), sum(math.log10((c + 1) / (N + V + 1)) for c in known), sum(math.log10(p(g)) for g in grams(tokens, order))))
    for h in [*list(histories[order])[:20], ("never",) * (order - 1)] if N else []:
        assert abs(sum(p((*h, w)) for w in unigrams) + p((*h, "unknown word")) - 1) < 1e-9
    return out


@pytest.mark.parametrize("order", [2, 3, 5])
def test_lm_equals_dictionaries(spark, sf, order):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(70).collect()]
    rows += [(9001, None), (9002, ""), (9003, "The THE the É é \x0b x"), (9003, "The THE the É é \x0b x"), (9004, "same " * 20_000)]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id bigint, text string, id string")
    train = [t for i, t in rows if i % 3]
    model = lm.train(docs.where("doc_id % 3 != 0"), order=order, shard_tokens=5000)
    assert all(f.bits >= 2 for f in model.levels.values()) and model.tokens == sum(len(words(t)) + 1 for t in train)
    got = sorted((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, model).collect())
    want = sorted((i, *w) for (i, _), w in zip(rows, brute(train, [t for _, t in rows], order)))
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4]), (g, w)


def test_lm_reads_a_bounded_share_of_a_store_that_is_not_mounted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    model = lm.train(docs, order=3, shard_tokens=5000)
    reader, small = lm.Reader(model), lm.Reader(model, most_bytes=40_000)
    small.mounted = False
    numbers = np.random.default_rng(3).integers(-1, model.vocabulary + 1, (3000, 3))
    for k in (2, 3):
        assert all((a == b).all() for a, b in zip(reader.grams(numbers[:, :k]), small.grams(numbers[:, :k])))
    largest = max(sum(a.nbytes for a in arrays) for arrays in reader.open.values())
    assert len(small.open) < len(reader.open) and sum(a.nbytes for x in small.open.values() for a in x) <= max(40_000, largest)


def test_lm_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="order"):
        lm.train(docs, order=1)
    assert sorted(r.n_tokens for r in lm.score(docs, lm.train(docs.limit(0), order=3)).collect()) == [1, 3]
    model = lm.train(docs.limit(0))
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, model).collect()) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert lm.score(docs.limit(0), model).count() == 0


def test_lm_query(spark, sf):
    rows = queries.op3_lm(spark, sf).collect()
    assert {r.held_out for r in rows} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def slow_viterbi(rows, penalty):
    """Best labelling by trying each label for each word, with first-label ties."""
    value, back = rows[0].astype(np.float32).copy(), []
    for row in rows[1:]:
        best = value.argmax()
        moved = value[best] - np.float32(penalty) > value
        back.append((best, moved))
        value = np.where(moved, value[best] - np.float32(penalty), value) + row
    state, out = int(value.argmax()), []
    for best, moved in reversed(back):
        out.append(state)
        state = int(best) if moved[state] else state
    return [state, *reversed(out)], float(value.max())


def test_viterbi_lanes():
    rng = np.random.default_rng(2)
    scores = rng.normal(0, 3, (50, 4)).astype(np.float32)
    lengths = np.array([3, 0, 17, 1, 60, 17])
    chosen = rng.integers(0, 50, lengths.sum())
    label = langid.viterbi(scores, chosen, lengths, 4.0)
    at = 0
    for n in lengths:
        if n:
            path, best = slow_viterbi(scores[chosen[at : at + n]], 4.0)
            assert label[at : at + n].tolist() == path
            rows = scores[chosen[at : at + n]]
            assert sum(rows[i, k] for i, k in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:])) == pytest.approx(best, abs=1e-3)
        at += n


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = langid.held_out(docs.doc_id)
    model = langid.train(docs.where(~held))
    found = {r.id: r for r in langid.identify(docs.where(held), model).collect()}
    want = {r.doc_id: r for r in docs.where(held).collect()}
    right = sum(found[i].lang == w.lang for i, w in want.items())
    assert len(found) == len(want) and right >= 0.97 * len(want)
    by = {w.lang: w.text for w in want.values() if 300 < len(w.text) < 5000}
    mixed = by["en"] + "\n" + by["fr"] + "\n" + by["de"]
    odd = spark.createDataFrame([(1, mixed, "x"), (2, None, None), (3, "", ""), (4, "12 -- 34", "en"), (6, "² ½ 12", "en"), (None, "Привет мир", ""), (5, by["en"] * 60, "")], "doc_id bigint, text string, lang string")
    got = {r.id: r for r in langid.identify(odd, model).collect()}
    assert [s.lang for s in got[1].spans if s.end - s.start > 100] == ["en", "fr", "de"]
    assert [(got[i].lang, got[i].score, got[i].spans) for i in (2, 3, 4, 6)] == [("und", 0.0, [])] * 4
    assert got[5].lang == "en" and 0 < got[1].score < 1 and got[None].lang in model.languages
    none = langid.train(odd.where("lang is null"))
    assert {r.lang for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_scripts_narrow(spark):
    docs = spark.createDataFrame([("ru", "привет мир это слово " * 30), ("el", "καλημέρα κόσμε αυτό " * 30), ("en", "good day to the world " * 30), (None, "x"), ("en", None)], "lang string, text string")
    model = langid.train(docs)
    allowed = {langid.NAMES[n]: [k for k, a in zip(model.languages, row) if a] for n, row in enumerate(model.allowed)}
    assert allowed["cyrillic"] == ["ru"] and allowed["greek"] == ["el"] and allowed["latin"] == ["en"] and len(allowed["han"]) == 3
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, max_languages=2)


def slow_grams(word):
    """Buckets of the n-grams of a word with its borders, number by number."""
    codes = [1, *map(ord, word), 1]
    for n in (1, 2, 3, 4):
        for at in range(len(codes) - n + 1):
            if n == 1 and codes[at] == 1:
                continue
            h = 0
            for c in codes[at : at + n]:
                h = (h * 0x9E3779B97F4A7C15 + c + 1) % (1 << 64)
            h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) % (1 << 64)
            yield h >> 48


def slow_script(word):
    return [name for first, name in langid.SCRIPTS if first <= ord(word[0])][-1]


def slow_model(rows):
    import math
    from collections import Counter

    grams, scripts = {}, {}
    for lang, text in rows:
        if lang is None or text is None:
            continue
        for word in langid.WORD.findall(text.lower()):
            grams.setdefault(lang, Counter()).update(slow_grams(word))
            scripts.setdefault(lang, Counter())[slow_script(word)] += len(word)
    weights = {x: (lambda b, x=x: math.log((grams[x][b] + 0.5) / (sum(grams[x].values()) + 0.5 * 65536))) for x in grams}
    used = {s for x in scripts for s, n in scripts[x].items() if n >= 0.001 * sum(scripts[x].values())}
    allowed = lambda s, x: s not in used or scripts[x][s] >= 0.001 * sum(scripts[x].values())
    return sorted(grams), weights, allowed


def slow_label(text, model, penalty=12.0):
    """(language, score, labels): every path by dynamic programming in plain numbers."""
    languages, weights, allowed = model
    words = langid.WORD.findall(text.lower()) if text else []
    if not words:
        return "und", 0.0, []
    table = []
    for w in words:
        one = [sum(weights[x](b) for b in slow_grams(w)) / 4 for x in languages]
        table.append([max(v - max(one), -40) + (0 if allowed(slow_script(w), x) else -40) for x, v in zip(languages, one)])
    value, paths = list(table[0]), [[k] for k in range(len(languages))]
    for now in table[1:]:
        top = value.index(max(value))
        stay = [v >= value[top] - penalty for v in value]
        paths = [(paths[k] if stay[k] else paths[top]) + [k] for k in range(len(languages))]
        value = [(value[k] if stay[k] else value[top] - penalty) + now[k] for k in range(len(languages))]
    labels = paths[value.index(max(value))]
    share = [sum(len(w) for w, k in zip(words, labels) if k == x) for x in range(len(languages))]
    return languages[share.index(max(share))], max(share) / sum(share), labels


def test_identification_equals_plain_numbers(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(60).collect()]
    rows += [("ru", "привет как дела " * 3), ("ru", "hello привет"), (None, "nothing"), ("xx", None), ("xx", "12 --"), *rows[:3]]
    model = langid.train(spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, key int"))
    slow = slow_model(rows)
    assert list(model.languages) == slow[0]
    some = sorted({w for _, t in rows if t for w in langid.WORD.findall(t.lower())})[:150]
    for x, language in enumerate(slow[0]):
        for w in some[::10]:
            for b in slow_grams(w):
                assert abs(model.weights[x][b] - slow[1][language](b)) < 1e-4
    for s, name in enumerate(langid.NAMES):
        assert model.allowed[s].tolist() == [slow[2](name, x) for x in slow[0]]
    texts = [t for _, t in rows] + ["", "привет the and of", "数字 words", " ".join((rows[0][1] or "").split()[:20] + ["как", "дела"] * 8), " ".join((rows[0][1] or "").split()[:20] + ["как", "дела"] * 8)]
    docs = spark.createDataFrame([(n, t, "a", 0.0) for n, t in enumerate(texts)], "doc_id bigint, text string, lang string, score double")
    for r in langid.identify(docs, model).collect():
        lang, score, labels = slow_label(texts[r.id], slow)
        assert (r.lang, round(r.score, 6)) == (lang, round(score, 6)), texts[r.id]
        assert [s.lang for s in r.spans] == [slow[0][k] for n, k in enumerate(labels) if not n or labels[n - 1] != k]
    assert langid.identify(docs.limit(0), model).count() == 0

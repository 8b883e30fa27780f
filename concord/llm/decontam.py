"""Benchmark decontamination: find passages of training texts that hold test items.

The test items are indexed: BM25 impacts, each divided by its item's best possible score,
in posting lists whose blocks know their largest impact. Every passage of every text is a
query. Block-max WAND runs for a bounded batch of passages at a time, one pivot each a turn,
over wide blocks that are the same in every list: lists that stand before the pivot skip to
it, and lists that cannot lift any item over the threshold never make one. The pivot's wide
block, and of that a block, is opened only if the largest impacts of the passage's lists in
it reach the threshold; the items in it that still can are scored whole, and all that reach
the threshold are retrieved. What is retrieved is verified by the overlap of the item's
question and of its answer with the passage.

Passages are windows of two strides, one stride apart; the stride is the item's length
rounded up to a power of two, so every item that a text holds lies whole in one of them, and
a long item does not widen the windows of short ones. Of passages with equal scores the
first is reported. Null and empty texts hold nothing; null ids are kept in the result;
repeated rows are reported again; very long texts are searched whole, slice by slice; items
with a null or wordless text match nothing, and items of equal text match alike. An empty
table of texts, or of items, gives no rows. Other columns, whatever their names, are left
out of the search and kept by :func:`clean`.

The index is sent to the workers. Items are test sets of at most ``max_bytes`` of text in
all, more is an error; a set of more than ``max_index_bytes`` is cut into shards that are
searched one after the other, with the statistics of the whole set.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm._common import filter_rows, map_texts

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK = 16  # items in a block
WIDE = 64  # blocks in a wide block
ENTRIES = 1 << 16  # lists of all passages that advance together
POSTINGS = 1 << 19  # parts of lists, or postings, that are looked at together
SHORTEST = 32  # words that a stride has at least


@dataclass(frozen=True)
class Limits:
    """``score``: share of an item's best BM25 score; ``question`` and ``answer``: shares of
    their word n-grams that the passage must hold, of ``question_words`` and ``answer_words``."""

    score: float = 0.5
    question: float = 0.5
    answer: float = 0.5
    question_words: int = 3
    answer_words: int = 2


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """All sentences but the last, and the last; of a single sentence the last quarter of
    the words, three at least where there are more than three."""
    parts = [w for w in (words_of(s) for s in re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(len(words) // 4, min(3, len(words) - 1)) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int) -> set:
    n = max(1, min(n, len(words)))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(wanted: list[str], passage: list[str], n: int) -> float:
    """The share of ``wanted``'s n-grams that the passage holds; 1 for no words."""
    if not wanted:
        return 1.0
    need = grams(wanted, n)
    n = max(1, min(n, len(wanted)))
    return len(need & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(need)


class Group:
    """Items of about one length: lists of postings of their terms, in blocks of items.

    ``terms`` and ``impacts``: for each item its distinct terms and what each is worth. Items
    are put in order by their terms, so that alike ones share a block; a block holds the same
    items in every list and knows each list's largest impact in it, and ``WIDE`` blocks are a
    wide block that does so too. Lists so common that together they give no item half the
    threshold never make a pivot: a passage needs ``missing[item]`` from the others.
    """

    def __init__(self, numbers: list[int], terms: list[np.ndarray], impacts: list[np.ndarray], words: list[str], stride: int, threshold: float):
        self.stride = stride
        size = np.array([len(t) for t in terms])
        owner, term, impact = np.repeat(np.arange(len(numbers)), size), np.concatenate(terms), np.concatenate(impacts)
        spread = np.bincount(term, minlength=len(words))
        known = np.flatnonzero(spread)
        ranked = np.array(sorted(known.tolist(), key=lambda w: (-spread[w], words[w])))
        by_term = np.argsort(term, kind="stable")
        ends = np.cumsum(spread)
        # common terms, the most widespread first, while no item has half the threshold from them
        share, common = np.zeros(len(numbers)), np.zeros(len(words), bool)
        for w in ranked.tolist():
            held = by_term[ends[w] - spread[w] : ends[w]]
            if spread[w] < 3 or (share[owner[held]] + impact[held]).max() > threshold / 2:
                break
            share[owner[held]] += impact[held]
            common[w] = True
        rank = np.zeros(len(words), ">i4")
        rank[ranked] = np.arange(len(ranked))
        alike = [np.sort(rank[t[~common[t] & (spread[t] > 1)]]).tobytes() for t in terms]
        order = sorted(range(len(numbers)), key=lambda n: (alike[n], n))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.numbers = [numbers[n] for n in order]
        self.terms, self.impacts = [terms[n].astype(np.int32) for n in order], [impacts[n] for n in order]
        self.missing = threshold - share[order] - 1e-9
        self.blocks = -(-len(order) // BLOCK)
        self.bar = np.minimum.reduceat(self.missing, np.arange(0, len(order), BLOCK))
        self.wide = -(-self.blocks // WIDE)
        self.wide_bar = np.minimum.reduceat(self.bar, np.arange(0, self.blocks, WIDE))
        # postings by list and item; parts: a list's postings in one block; wide parts: in WIDE blocks
        listed = np.flatnonzero(~common[term])
        self.words = np.flatnonzero((spread > 0) & ~common)
        number = np.full(len(words), -1, np.int64)
        number[self.words] = np.arange(len(self.words))
        item, of = place[owner[listed]], number[term[listed]]
        turn = np.lexsort((item, of))
        of, self.item, self.impact = of[turn], item[turn].astype(np.int32), impact[listed][turn]
        self.own = number.astype(np.int32)
        self.first, key = _starts(of * self.blocks + self.item // BLOCK)
        self.block, self.most = (key % self.blocks).astype(np.int32), np.maximum.reduceat(self.impact, self.first[:-1]) if len(key) else np.zeros(0)
        self.wide_first, self.wide_key = _starts(key // self.blocks * self.wide + key % self.blocks // WIDE)
        self.wide_most = np.maximum.reduceat(self.most, self.wide_first[:-1]) if len(key) else np.zeros(0)
        self.start = np.searchsorted(self.wide_key, np.arange(len(self.words) + 1) * self.wide)
        self.list_most = np.maximum.reduceat(self.wide_most, self.start[:-1]) if len(key) else np.zeros(0)

    def candidates(self, terms: np.ndarray, passage: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passage, item) pairs that may reach the threshold, for distinct (term, passage) in
        the order of passages, a bounded batch of passages at a time."""
        for batch in _batches(passage, np.ones(len(passage), np.int64), ENTRIES):
            for at, of in self._pivots(terms[batch], passage[batch]):
                yield from self._opened(at, of)

    def _pivots(self, lists: np.ndarray, passage: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(wide part, passage) of the wide blocks whose largest impacts reach the threshold.

        WAND, all passages of a batch one step a turn: a passage's lists stand in the order of the
        wide block that each is at; the pivot is the first where the lists up to it, by the most
        that each gives anywhere, reach the threshold. No wide block before it can; lists that
        stand before it skip to it, and its bound is the sum of what they give at most in it."""
        at, end, low = self.start[lists], self.start[lists + 1], self.wide_bar.min()
        while len(at):
            here = self.wide_key[at] - lists * self.wide
            turn = np.lexsort((here, passage))
            at, end, lists, passage, here = (v[turn] for v in (at, end, lists, passage, here))
            new = np.diff(passage, prepend=-1) > 0
            segment = np.cumsum(new) - 1
            most = self.list_most[lists]
            total = np.cumsum(most)
            begun = (total - most)[new]
            reach = total - begun[segment] >= low
            pivot = reach & (new | ~np.concatenate([[False], reach[:-1]]))
            goal = np.full(int(segment[-1]) + 1, -1, np.int64)
            goal[segment[pivot]] = here[pivot]
            alive = goal[segment] >= 0
            at, end, lists, passage, segment = (v[alive] for v in (at, end, lists, passage, segment))
            if not len(at):
                return
            wanted = goal[segment]
            at = np.maximum(at, np.searchsorted(self.wide_key, lists * self.wide + wanted))
            met = at < end
            met[met] = self.wide_key[at[met]] == lists[met] * self.wide + wanted[met]
            bound = np.bincount(segment[met], weights=self.wide_most[at[met]], minlength=len(goal))
            live = met & (bound >= self.wide_bar[np.maximum(goal, 0)])[segment]
            if live.any():
                yield at[live], passage[live]
            at = at + met
            left = at < end
            at, end, lists, passage = (v[left] for v in (at, end, lists, passage))

    def _opened(self, wide_parts: np.ndarray, passage: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the wide blocks that reach the threshold by their largest impacts, and of
        their items those that do by their own."""
        for batch in _batches(passage, self.wide_first[wide_parts + 1] - self.wide_first[wide_parts], POSTINGS):
            part, of = _ranges(self.wide_first[wide_parts[batch]], self.wide_first[wide_parts[batch] + 1])
            keys, back = np.unique(passage[batch][of] * self.blocks + self.block[part], return_inverse=True)
            live = np.bincount(back, weights=self.most[part]) >= self.bar[keys % self.blocks]
            chosen = live[back]
            part, key = part[chosen], keys[back[chosen]]
            turn = np.argsort(key, kind="stable")
            part, key = part[turn], key[turn]
            for inner in _batches(key, self.first[part + 1] - self.first[part], POSTINGS):
                posting, of = _ranges(self.first[part[inner]], self.first[part[inner] + 1])
                if not len(posting):
                    continue
                pairs, back = np.unique((key[inner][of] // self.blocks) * len(self.numbers) + self.item[posting], return_inverse=True)
                item = pairs % len(self.numbers)
                full = np.bincount(back, weights=self.impact[posting], minlength=len(pairs)) >= self.missing[item]
                if full.any():
                    yield pairs[full] // len(self.numbers), item[full]

    def score(self, item: int, inside: np.ndarray) -> float:
        """The whole score of an item for a passage's terms, sorted."""
        own = self.terms[item]
        at = np.searchsorted(inside, own)
        return float(self.impacts[item][(at < len(inside)) & (inside[np.minimum(at, len(inside) - 1)] == own)].sum())


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the end; and the keys once."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return np.append(first, len(keys)), keys[first]


def _batches(group: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of whole groups whose sizes add up to ``most`` at most, or one group."""
    if not len(group):
        return
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    total = np.cumsum(sizes)[ends - 1]
    start, begun = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(total, begun + most, side="right")))
        yield slice(int(ends[start - 1]) if start else 0, int(ends[stop - 1]))
        start, begun = stop, int(total[stop - 1])


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges behind each other, and which range each is of."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of], of


class Index:
    """``items``: (id, text); ``df``, ``total`` and ``mean``: statistics of the whole set. Items
    whose lengths round up to the same power of two are a group with windows of its own.
    Everything is numbers: terms of the items have one each, which texts are turned into."""

    def __init__(self, items: list[tuple], df: Counter, total: int, mean: float, threshold: float):
        self.threshold, self.items = threshold, []
        self.terms: dict[str, int] = {}
        groups: dict[int, tuple[list, list, list]] = {}
        numbered = lambda words: np.fromiter((self.terms.setdefault(w, len(self.terms)) for w in words), np.int32, len(words))
        for n, (identifier, text) in enumerate(items):
            words = words_of(text)
            self.items.append((identifier, *map(numbered, question_and_answer(text))))
            counts = Counter(words)
            own = numbered(list(counts))
            weight = np.array([math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in counts.items()])
            numbers, terms, impacts = groups.setdefault(stride_for(len(words)), ([], [], []))
            numbers.append(n)
            terms.append(own)
            impacts.append(weight / weight.sum())
        names = list(self.terms)
        self.groups = [Group(*groups[stride], names, stride, threshold) for stride in sorted(groups)]

    def search(self, texts: list[str | None], limits: Limits) -> list[tuple]:
        """(row, item id, score, question overlap, answer overlap, first word, words) of each
        item that a text holds, at the passage where its score is best, the first of equals."""
        get, absent = self.terms.get, repeat(-1)
        found = [np.fromiter(map(get, words, absent), np.int32, len(words)) for words in map(words_of, texts)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        hits = np.concatenate(found) if found else np.zeros(0, np.int32)
        place = np.flatnonzero(hits >= 0)
        if not len(place):
            return []
        ends = np.cumsum(lengths)
        row = np.searchsorted(ends, place, side="right")
        terms, place = hits[place], place - (ends - lengths)[row]
        best: dict[tuple[int, int], tuple] = {}
        for g in self.groups:
            own = g.own[terms]
            mine = own >= 0
            first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-lengths // g.stride)))])
            step = place[mine] // g.stride
            late = first[row[mine]] + step  # passage p covers strides p and p + 1
            inner = step > 0
            own = own[mine].astype(np.int64)
            held = np.sort(np.concatenate([late, late[inner] - 1]) * len(g.words) + np.concatenate([own, own[inner]]))
            held = held[np.diff(held, prepend=-1) > 0]
            for passages, items in g.candidates(held % len(g.words), held // len(g.words)):
                last, words, inside = -1, None, None
                for p, item in zip(passages.tolist(), items.tolist()):
                    r = int(np.searchsorted(first, p, side="right")) - 1
                    at = int(p - first[r]) * g.stride
                    if p != last:
                        last, words = p, found[r][at : at + 2 * g.stride]
                        inside = np.unique(words[words >= 0])
                    score, n = g.score(item, inside), g.numbers[item]
                    old = best.get((r, n))
                    if score >= self.threshold - 1e-9 and (old is None or score > old[2] or (score == old[2] and at < old[5])):
                        identifier, question, answer = self.items[n]
                        passage = words.tolist()
                        q, a = overlap(question.tolist(), passage, limits.question_words), overlap(answer.tolist(), passage, limits.answer_words)
                        if q >= limits.question and a >= limits.answer:
                            best[r, n] = (r, identifier, score, q, a, at, len(words))
        return list(best.values())


def stride_for(words: int) -> int:
    """Half the length of the passages that an item of so many words is looked for in."""
    return max(SHORTEST, 1 << (words - 1).bit_length())


def build(items: DataFrame, id_col: str = "item_id", text_col: str = "text", limits: Limits | None = None, max_index_bytes: int = 8 << 20, max_bytes: int = 64 << 20) -> list[Index]:
    """The index of all items, in shards of at most ``max_index_bytes`` of text (or one item);
    ``ValueError`` for more than ``max_bytes`` in all, which bounds what the driver holds."""
    limits = limits or Limits()
    df: Counter = Counter()
    shards, size, total, length, whole = [[]], 0, 0, 0, 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        if (whole := whole + len(r["t"])) > max_bytes:
            raise ValueError(f"the items have more than {max_bytes} characters")
        df.update(set(words))
        total, length = total + 1, length + len(words)
        if size and size + len(r["t"]) > max_index_bytes:
            shards.append([])
            size = 0
        size += len(r["t"])
        shards[-1].append((r["i"], r["t"]))
    return [Index(s, df, total, length / total, limits.score) for s in shards if s]


SCHEMA = "id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint, n_words bigint"


def find_leaks(docs: DataFrame, index: list[Index], id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """One row for each test item that a whole text holds: (id, item_id, score,
    question_overlap, answer_overlap, first_word, n_words), the passage by its words."""
    limits = limits or Limits()
    out = None
    for shard in index:
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(ids, texts, shared=shared):
            rows = shared.value.search(texts, limits)
            columns = list(zip(*rows)) or [()] * 7
            return dict(zip(("id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "n_words"), ([ids[r] for r in columns[0]], *columns[1:])))

        part = map_texts(docs, id_col, text_col, SCHEMA, run, max_bytes=2 << 20)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, index: list[Index], text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows that hold no test item, with all their columns."""
    limits = limits or Limits()
    for shard in index:
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def keep(texts, shared=shared):
            leaky = {r[0] for r in shared.value.search(texts, limits)}
            return [n not in leaky for n in range(len(texts))]

        docs = filter_rows(docs, text_col, keep, max_bytes=2 << 20)
    return docs

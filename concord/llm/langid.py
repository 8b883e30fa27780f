"""Language identification with spans for mixed-language text.

Training counts hashed character n-grams of words by language over all labelled rows, and
the scripts of their letters. For a text, Unicode script ranges narrow the candidate
languages of each word, a naive Bayes score rates the candidates, and the Viterbi algorithm
with a penalty for switching labels the words; runs of one label are the spans. The label
that covers most letters is the language of the text; its share of them is the score.

Null texts and texts without a letter are ``und`` with score 0 and no spans. Ties go to the
label that sorts first. With nothing to learn from every text is ``und``. Null ids are
kept; repeated rows are labelled again, and counted again in training; rows with a null
label or text teach nothing. Very long texts are labelled whole; an empty table gives an empty
result; other columns, whatever their names, are left out of the work.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm._common import filter_rows, kept, map_texts, slices, sum_arrays

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Bytes of text that a worker handles at once: its words and their n-grams take many times that.
SLICE = 2 << 20
#: Text counts as a language if its n-grams are this far up from what another language has.
LEAST_LIKE = 0.4
#: Unicode ranges of scripts: first code point and name; a range ends where the next begins.
SCRIPTS: list[tuple[int, str]] = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1900, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([a for a, _ in SCRIPTS], dtype=np.uint32)
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS], dtype=np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of every n-gram of each word with its borders, then the script of
    each word's first letter and its number of letters."""
    codes = np.frombuffer(("\1" + "\1\0\1".join(words) + "\1").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    breaks = codes == 0
    owner = np.cumsum(breaks)
    owners, buckets = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolling = rolling[:size] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
        if n not in ORDERS:
            continue
        inside = (owner[:size] == owner[n - 1 :]) & ~breaks[:size]
        if n == 1:
            inside &= codes != 1
        mixed = rolling[inside]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[:size][inside])
        buckets.append((mixed >> np.uint64(48)).astype(np.int64))
    starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    script = _SCRIPT[np.searchsorted(_FIRST, codes[starts + 1].astype(np.uint32), side="right") - 1]
    return np.concatenate(owners), np.concatenate(buckets), script, np.fromiter(map(len, words), np.int64, len(words))


@dataclass(frozen=True)
class Model:
    """``weights``: languages x buckets, log probabilities; ``allowed``: scripts x languages;
    ``used``: the same, false where no language uses a script; ``usual``: what an n-gram of a
    language has on average; ``least``: what text must have to count as that language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    allowed: np.ndarray
    name: str = ""
    used: np.ndarray | None = None
    usual: np.ndarray | None = None
    least: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """Words x languages: log likelihoods, centred; barred languages far below."""
        return self.rated(words)[0]

    def rated(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`score`, and of each word the largest log likelihood that was taken off, its
        number of n-grams and its script."""
        owner, bucket, script, _ = features(words)
        total = np.zeros((len(words), len(self.languages)), np.float32)
        for n, row in enumerate(self.weights):
            total[:, n] = np.bincount(owner, weights=row[bucket], minlength=len(words))
        total /= len(ORDERS)
        most = total.max(axis=1, keepdims=True)
        total -= most
        total = np.maximum(total, -40) + np.where(self.allowed[script], 0, -40).astype(np.float32)
        return total, most[:, 0], np.bincount(owner, minlength=len(words)).astype(np.float32), script.astype(np.int16)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, script_share: float = 0.001, max_languages: int = 512) -> Model:
    """Count over all rows. What reaches the driver is one array of 65,536 buckets and a few
    scripts for each language; more than ``max_languages`` labels raise ``ValueError``."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                words: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                for lang, counter in words.items():
                    if counter:
                        owner, bucket, script, letters = features(list(counter))
                        times = np.fromiter(counter.values(), np.float64, len(counter))
                        one = np.concatenate([np.bincount(bucket, weights=times[owner], minlength=BUCKETS), np.bincount(script, weights=times * letters, minlength=len(NAMES))])
                        sums[lang] = sums[lang] + one if lang in sums else one
                        if len(sums) > max_languages:
                            raise ValueError(f"more than {max_languages} languages")
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([task] * len(sums), pa.int32()), pa.array([zlib.compress(a.astype(np.int64).tobytes(), 1) for a in sums.values()], pa.binary())], names=["key", "task", "data"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = sum_arrays(rows.mapInArrow(count, "key string, task int, data binary"), "<i8")
    if len(sums) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sums:
        return Model((), np.zeros((0, BUCKETS), np.float32), np.zeros((len(NAMES), 0), bool))
    counts = np.stack([a[:BUCKETS] for _, a in sums]).astype(np.float64)
    scripts = np.stack([a[BUCKETS:] for _, a in sums]).astype(np.float64)
    weights = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS))
    allowed = (scripts >= script_share * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    used = allowed.copy()
    allowed[~allowed.any(axis=1)] = True  # a script that no language uses narrows nothing
    usual, least = _likelihoods(counts, weights)
    return Model(tuple(k for k, _ in sums), weights.astype(np.float32), allowed, uuid.uuid4().hex, used, usual, least)


def _likelihoods(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each language the mean log probability of its own n-grams, and the least that text
    must have on average to be taken for it: ``LEAST_LIKE`` of the way up from what the most
    alike other language has under it, or, with a single language, from that of an n-gram never
    seen. Everything follows from the counts of the whole training text."""
    shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    crossed = shares @ weights.T  # row: whose n-grams, column: under which language
    usual = np.diag(crossed).copy()
    others = np.where(np.eye(len(usual), dtype=bool), -np.inf, crossed).max(axis=0)
    others = np.where(np.isfinite(others), others, weights.min(axis=1))
    return usual, others + LEAST_LIKE * (usual - others)


def viterbi(scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word of many texts at once. ``words`` are rows of ``scores``,
    the texts behind each other; a change of label costs ``penalty``. Texts run as lanes,
    the longest first, so that each step works on the lanes that are still open."""
    lanes = np.argsort(-lengths, kind="stable")
    size = lengths[lanes]
    begin = (np.cumsum(lengths) - lengths)[lanes]
    steps = int(size[0]) if len(size) else 0
    open_ = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes longer than t
    value = np.zeros((len(lanes), scores.shape[1]), np.float32)
    moved = np.zeros((int(lengths.sum()), scores.shape[1]), bool)
    came = np.zeros(len(moved), np.int16)
    for t in range(steps):
        n = open_[t]
        at = begin[:n] + t
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            switched = now[np.arange(n), best] - np.float32(penalty)
            moved[at] = switched[:, None] > now
            came[at] = best
            np.maximum(now, switched[:, None], out=now)
        now += scores[words[at]]
    label = np.zeros(len(moved), np.int16)
    state = value.argmax(axis=1) if value.size else np.zeros(len(lanes), np.int64)
    for t in range(steps - 1, -1, -1):
        n = open_[t]
        at, now = begin[:n] + t, state[:n]
        label[at] = now
        state[:n] = np.where(moved[at, now], came[at], now)
    return label


SCHEMA = "id bigint, lang string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>"


class Labeller:
    """Labels words with a model, remembering the scores of recent words: at most ``limit``
    words and ``most_bytes`` of scores, or one slice's words if those are more."""

    def __init__(self, model: Model, penalty: float, limit: int = 200_000, most_bytes: int = 64 << 20):
        self.model, self.penalty = model, penalty
        self.limit = max(1, min(limit, most_bytes // (4 * max(1, len(model.languages)))))
        self.index: dict[str, int] = {}
        self.scores = np.zeros((min(self.limit, 1 << 14), len(model.languages)), np.float32)
        self.most, self.grams, self.script = (np.zeros(len(self.scores), t) for t in (np.float32, np.float32, np.int16))

    def __call__(self, texts: list[str | None], shares: bool = True) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language and score of each text, the label of every word, word counts, and the share
        of each text's letters that is identified: in words whose label uses their script,
        where all such words of the label in the text are likely enough under it (0 without ``shares``)."""
        count = len(self.model.languages)
        if not count:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(0, np.int16), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        index = self.index
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        fresh = set().union(*found).difference(index)
        if len(index) + len(fresh) > self.limit and index:
            index.clear()
            fresh = set().union(*found)
        if fresh:
            fresh, at = list(fresh), len(index)
            index.update(zip(fresh, range(at, at + len(fresh))))
            if len(index) > len(self.scores):  # doubled, so that growing copies each score twice at most
                grown = np.zeros((max(len(index), min(self.limit, 2 * len(self.scores))), count), np.float32)
                grown[:at] = self.scores[:at]
                self.scores = grown
                self.most, self.grams, self.script = (np.append(v[:at], np.zeros(len(grown) - at, v.dtype)) for v in (self.most, self.grams, self.script))
            part = slice(at, len(index))
            self.scores[part], self.most[part], self.grams[part], self.script[part] = self.model.rated(fresh)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        words = np.fromiter((index[w] for f in found for w in f), np.int64, int(lengths.sum()))
        letters = np.fromiter((len(w) for f in found for w in f), np.int64, len(words))
        label = viterbi(self.scores, words, lengths, self.penalty)
        owner = np.repeat(np.arange(len(found)), lengths)
        share = np.bincount(owner * count + label, weights=letters, minlength=len(found) * count).reshape(-1, count)
        best = share.argmax(axis=1)
        score = share[np.arange(len(found)), best] / np.maximum(share.sum(axis=1), 1)
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])  # digits of other kinds are no letters
        lang = [self.model.languages[b] if n else "und" for b, n in zip(best.tolist(), lettered.tolist())]
        return lang, np.where(lettered, score, 0.0), label, lengths, self._identified(words, owner, label, letters, len(found)) if shares else np.zeros(len(found))

    def _identified(self, words: np.ndarray, owner: np.ndarray, label: np.ndarray, letters: np.ndarray, texts: int) -> np.ndarray:
        model, count = self.model, len(self.model.languages)
        if model.used is None or not len(words):
            return np.zeros(texts)
        ours = model.used[self.script[words], label]
        key = owner * count + label
        bins = lambda weights: np.bincount(key[ours], weights=weights[ours], minlength=texts * count).reshape(-1, count)
        grams = self.grams[words]
        likely = (self.scores[words, label] + self.most[words]) * len(ORDERS)
        total = bins(grams)
        with np.errstate(invalid="ignore", divide="ignore"):
            good = bins(likely) / total >= model.least
        return np.where(good, bins(letters), 0.0).sum(axis=1) / np.maximum(np.bincount(owner, weights=letters, minlength=texts), 1)


def labeller_for(model: Model, penalty: float) -> Labeller:
    """The labeller of this worker for a model, shared by all its tasks."""
    return kept(("langid", model.name, penalty), lambda: Labeller(model, penalty))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, with_spans: bool = True) -> DataFrame:
    """(id, lang, score, spans) of every whole text; span offsets count characters. The model
    that is sent along is bounded: languages x 65,536 numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        lang, score, label, lengths, _ = labeller_for(shared.value, penalty)(texts, shares=False)
        spans: list = [[]] * len(ids)
        if with_spans:
            ends = np.cumsum(lengths)
            spans = [_spans(t, label[e - n : e], shared.value.languages) if n and x != "und" else [] for t, n, e, x in zip(texts, lengths.tolist(), ends.tolist(), lang)]
        return {"id": ids, "lang": lang, "score": score.tolist(), "spans": spans}

    return map_texts(docs, id_col, text_col, SCHEMA, run, max_bytes=SLICE)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 12.0, least_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, of whose text at least ``least_score`` of the letters
    are in spans of identified languages, however many these are: the script must be one that
    the language uses, and the span as likely as text of that language is. ``und`` goes, and
    so does text in languages or scripts that were not learnt, and noise."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts):
        lang, *_, known = labeller_for(shared.value, penalty)(texts)
        return [x != "und" and s >= least_score for x, s in zip(lang, known.tolist())]

    return filter_rows(docs, text_col, keep, max_bytes=SLICE)


def _spans(text: str, label: np.ndarray, languages: tuple[str, ...]) -> list[dict]:
    places = [m.span() for m in WORD.finditer(text)]
    if len(places) != len(label):  # lower case has other word borders here
        places = [m.span() for m in WORD.finditer(text.lower())]
    cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
    return [{"lang": languages[label[a]], "start": places[a][0], "end": places[b - 1][1]} for a, b in zip(cuts, cuts[1:])]


def held_out(id_column, modulus: int = 4, remainder: int = 2):
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string")) % modulus == remainder, F.lit(False))

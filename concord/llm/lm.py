"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any order
from 2.

Counting runs in Spark. A first pass counts words and writes the vocabulary: 64-bit word
hashes, sorted, in shards by their leading bits; a word's place in them is its number. A
second counts the longest n-grams of numbers and writes the sorted hashes of the n-grams
and their counts in shards by leading bits; while merging a shard it sums what each n-gram
gives to the one without its last word (a history) and to the one without its first word
(distinct words before it). These sums are shuffled to the next shorter order, and so on
down to words. Workers memory-map these arrays to score texts.

A task combines what it counts before anything is shuffled, and a shard holds about as many
n-grams as ``SHARD`` tokens have, whatever single words weigh: keys are spread by their
hash. Keys of pairs are exact (a bijection); longer ones are 64-bit hashes.

P(w|h) = max(c(hw) - D, 0) / c(h) + gamma(h) P(w|h'), where h' is h without its first word
and shorter orders take the number of distinct words before the n-gram for its count, with
the uniform distribution over the vocabulary and the unknown word below the words. A text
starts after as many marks of its beginning as a history is long. Null texts are empty: they have the end only. Rows with a null id are scored
and neither held out nor trained on. Repeated rows count again. With no training rows every
token is unknown and has probability one. Very long texts are scored whole; ties do not
matter, an empty table gives an empty result; other columns, whatever their names, are left
out first.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm._common import discard, kept, map_texts, materialize, shared_path, slices

#: Tokens for which a shard is meant.
SHARD = 1 << 20
END = xxhash.xxh3_64_intdigest(b" end")  # no word holds a space
BEGIN = xxhash.xxh3_64_intdigest(b" begin")  # a history only
U = np.uint64
COUNT = ("<u4", "<u8")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, cut at ASCII white space."""
    return text.encode().lower().split() if text else []


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = keys ^ (keys >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out, step = x, by
    while step < 64:
        out = x ^ (out >> U(by))
        step += by
    return out


def unmix(x: np.ndarray) -> np.ndarray:
    x = _unshift(x, 31) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = _unshift(x, 27) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return _unshift(x, 30)


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of two or more word numbers; those of pairs can be undone."""
    g = grams.astype(U)
    key = mix(g[:, 0] << U(32) | g[:, 1])
    for n in range(2, g.shape[1]):
        key = mix(key * U(0x9E3779B97F4A7C15) + g[:, n])
    return key


# ---------------------------------------------------------------- packed arrays


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, and counts, by byte planes, compressed."""
    body = _planes(np.diff(keys, prepend=U(0)))
    body += b"".join(_planes(np.ascontiguousarray(c, dtype="<u8")) for c in counts)
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8) if n else np.zeros(0, np.uint8)
    keys = np.ascontiguousarray(body[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    out = [np.cumsum(keys, dtype=U)]
    for at in range(8 * n, len(body), 8 * n or 1):
        out.append(np.ascontiguousarray(body[at : at + 8 * n].reshape(8, n).T).view("<u8").ravel())
    return out


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum the counts of equal keys of many packed rows."""
    keys, _, counts = _distinct(np.concatenate([p[0] for p in parts]), None, [np.concatenate([p[k] for p in parts]) for k in range(1, len(parts[0]))])
    return [keys, *counts]


def _split(bits: int, keys: np.ndarray) -> list[int]:
    """Where the shards of sorted keys begin and end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits) if bits else np.zeros(0, U)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


SHARDED = pa.schema([("shard", pa.int32()), ("data", pa.binary())])


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=SHARDED)


def _rows(bits: int, keys: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    cut = _split(bits, keys)
    return _batch([(s, pack(keys[a:b], *(c[a:b] for c in counts))) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])


def _distinct(keys: np.ndarray, grams: np.ndarray | None, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]:
    """Sorted distinct keys, their n-grams, and sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values]
    return keys[first], None if grams is None else grams[order[first]], sums


def pack_grams(keys: np.ndarray, grams: np.ndarray, values: list[np.ndarray]) -> bytes:
    """N-grams with counts: pairs as their keys, longer ones as the numbers of their words."""
    if grams.shape[1] == 2:
        return pack(keys, *values)
    return pack(np.zeros(len(keys), U), *grams.T, *values)


def unpack_grams(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys, *values = unpack(data)
    if k == 2:
        pair = unmix(keys)
        return keys, np.stack([pair >> U(32), pair & U(0xFFFFFFFF)], axis=1).astype(np.uint32), values
    grams = np.stack(values[:k], axis=1).astype(np.uint32)
    return gram_keys(grams), grams, values[k:]


def _gram_rows(bits: int, keys: np.ndarray, grams: np.ndarray, values: list[np.ndarray]) -> list[tuple[int, bytes]]:
    cut = _split(bits, keys)
    return [(s, pack_grams(keys[a:b], grams[a:b], [v[a:b] for v in values])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _by_shard(batches, read=unpack):
    """(shard, what ``read`` makes of its rows) of consecutive rows of a shard."""
    shard, parts = None, []
    for batch in batches:
        for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != shard and parts:
                yield shard, parts
                parts = []
            shard = s
            parts.append(read(data))
    if parts:
        yield shard, parts


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """Arrays behind each other in a file of a name of its own; returns its name."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}.bin"
    with store.open_output_stream(f"{base}/{name}") as out:
        for a in arrays:
            out.write(a.tobytes())
    return name


def _map(folder: str, name: str, kinds: list[str], n: int) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped where the folder is a mounted one, else read whole."""
    store, base = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(f"{base}/{name}", np.uint8, "r") if n else np.zeros(0, np.uint8)
    else:
        with store.open_input_file(f"{base}/{name}") as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


# ---------------------------------------------------------------- the model


@dataclass
class Files:
    """Shards of sorted arrays: names and lengths by shard number."""

    folder: str
    bits: int
    names: dict[int, tuple[str, int]] = field(default_factory=dict)


@dataclass
class Model:
    """What the driver keeps: file names, totals and discounts; never a word or an n-gram."""

    order: int
    words: Files
    levels: dict[int, Files]  # n-grams of 2 to ``order`` words
    statistics: Files
    offsets: np.ndarray  # the number of the first word of each shard
    tokens: int
    pair_kinds: int = 0
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # by length
    low_gamma: float = 1.0
    begin: tuple[float, float] = (1.0, 0.0)  # gamma and count of the beginning of a text

    @property
    def vocabulary(self) -> int:
        return int(self.offsets[-1])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many items occur 1, 2, 3 and 4 times; fixed
    ones where the corpus is too small to tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not all((n1, n2, n3, n4)):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


class Reader:
    """Arrays of a model, opened when first needed: memory-mapped, or, on a store that is not
    mounted, read and held up to ``most_bytes`` or the last one read."""

    def __init__(self, model: Model, most_bytes: int = 256 << 20):
        self.model, self.most_bytes = model, most_bytes
        self.open: dict[tuple[str | int, int], list[np.ndarray]] = {}
        self.mounted = isinstance(fs.FileSystem.from_uri(model.words.folder)[0], fs.LocalFileSystem)

    def _arrays(self, which: str | int, shard: int) -> list[np.ndarray] | None:
        m = self.model
        files = m.words if which == "words" else m.statistics if which == "statistics" else m.levels[which]
        if shard not in files.names:
            return None
        if (which, shard) not in self.open:
            name, size = files.names[shard]
            if which == "words":
                kinds = ["<u8", "<u8"]
            elif which == "statistics":
                kinds = ["<u8", "<u4", "<u4", "<u4", "<u4"]
            else:  # n-grams: counts, and where they are histories sums and gammas
                count = COUNT[name.startswith("grams8")]
                kinds = ["<u8", count] if which == m.order else ["<u8", count, count, "<f4"]
            if not self.mounted:
                need = size * sum(np.dtype(k).itemsize for k in kinds)
                while self.open and need + sum(a.nbytes for arrays in self.open.values() for a in arrays) > self.most_bytes:
                    del self.open[next(iter(self.open))]  # the one read first
            self.open[which, shard] = _map(files.folder, name, kinds, size)
        return self.open[which, shard]

    def _find(self, which: str | int, bits: int, keys: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        """Places of sorted keys in their shards, -1 if absent; fills ``values`` for those found."""
        cut = _split(bits, keys)
        place = np.full(len(keys), -1, np.int64)
        for shard, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a and (arrays := self._arrays(which, shard)) is not None:
                known = arrays[0]
                at = np.searchsorted(known, keys[a:b])
                at[at == len(known)] = 0
                hit = known[at] == keys[a:b]
                place[a:b][hit] = at[hit]
                for target, array in zip(values, arrays[1:]):
                    target[a:b][hit] = array[at[hit]]
        return place

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words (-1: unknown) and their counts."""
        order = np.argsort(hashes)
        count = np.zeros(len(order), np.int64)
        place = self._find("words", self.model.words.bits, hashes[order], [count])
        shard = (hashes[order] >> U(64 - self.model.words.bits)).astype(np.int64) if self.model.words.bits else np.zeros(len(order), np.int64)
        number = np.where(place >= 0, self.model.offsets[shard] + place, -1)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return number[back], count[back]

    def grams(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, sum as a history, gamma as a history) of rows of numbers; 0, 0 and 1 where
        the model lacks the n-gram or one of its words (-1)."""
        k = grams.shape[1]
        known = np.flatnonzero((grams >= 0).all(axis=1))
        keys, where = np.unique(gram_keys(grams[known]), return_inverse=True)
        found = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys))]
        self._find(k, self.model.levels[k].bits, keys, found)
        out = [np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64), np.ones(len(grams))]
        for target, values in zip(out, found):
            target[known] = values[where]
        return tuple(out)

    def word_statistics(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum as a history, gamma as a history, lower-order probability) of words by number;
        an unknown word (-1) passes everything on and has the unknown word's probability."""
        m = self.model
        history = np.zeros(len(numbers), np.int64)
        gamma = np.ones(len(numbers))
        uniform = 1 / (m.vocabulary + 1)
        low = np.full(len(numbers), m.low_gamma * uniform)
        shard = np.searchsorted(m.offsets, numbers, side="right") - 1
        for s in np.unique(shard[numbers >= 0]).tolist():
            if (arrays := self._arrays("statistics", s)) is None:
                continue
            here = np.flatnonzero((shard == s) & (numbers >= 0))
            at = numbers[here] - m.offsets[s]
            c, n1, n2, n3, before = (a[at].astype(np.float64) for a in arrays)
            history[here] = c
            gamma[here] = np.where(c > 0, np.tensordot(m.discounts[2], [n1, n2, n3], 1) / np.maximum(c, 1), 1.0)
            low[here] += np.maximum(before - discounted(m.discounts[1], before), 0) / max(m.pair_kinds, 1)
        return history, gamma, low


def discounted(discount: tuple[float, float, float], counts: np.ndarray) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *discount])[np.minimum(counts, 3).astype(np.int64)]


def _names(rows) -> dict[int, tuple[str, int]]:
    return {r["shard"]: (r["name"], r["size"]) for r in rows}


def _power(x: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, x)))))


def train(docs: DataFrame, text_col: str = "text", order: int = 2, shard_tokens: int = SHARD) -> Model:
    """Count all rows, n-grams of up to ``order`` words. The driver gathers file names and totals of shards only; everything
    that grows with the text lies in files in the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.lit(0).alias("k"), F.col(text_col).cast("string").alias("text"))
    folder = shared_path(spark, "lm")

    # words
    word_bits = max(6, _power(texts.rdd.getNumPartitions()))

    def count_words(batches):
        from collections import Counter

        total: Counter = Counter()
        ends = 0

        def flush():
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, total), U, len(total))
            counts = np.fromiter(total.values(), np.int64, len(total))
            hashes, counts = np.append(hashes, U(END)), np.append(counts, ends)
            order = np.argsort(hashes)
            return _rows(word_bits, hashes[order], counts[order])

        for batch in batches:
            for part in slices(batch, 1):
                for text in part.column(1).to_pylist():
                    total.update(words_of(text))
                    ends += 1
                if len(total) > 400_000:
                    yield flush()
                    total.clear()
                    ends = 0
        if ends:
            yield flush()

    def write_words(batches):
        rows = []
        for shard, parts in _by_shard(batches):
            keys, counts = merged(parts)
            rows.append((shard, _write(folder, f"words-{shard}", [keys, counts.astype("<u8")]), len(keys), int(counts.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "name", "size", "total"])

    def dealt(rows: DataFrame, bits: int) -> DataFrame:
        return rows.repartition(1 << bits, "shard").sortWithinPartitions("shard")

    listed = materialize(dealt(texts.mapInArrow(count_words, "shard int, data binary"), word_bits).mapInArrow(write_words, "shard int, name string, size bigint, total bigint"), "lm-words").collect()
    words = Files(folder, word_bits, _names(listed))
    sizes = np.array([words.names.get(s, ("", 0))[1] for s in range(1 << word_bits)])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    tokens = sum(r["total"] for r in listed)
    bits = _power(tokens / shard_tokens)
    model = Model(order, words, {k: Files(folder, bits) for k in range(2, order + 1)}, Files(folder, word_bits), offsets, tokens)
    begin = model.vocabulary  # the number of the beginning, after all words
    if begin >= (1 << 32) - 1:
        raise ValueError(f"{begin} distinct words: more than 32 bits number")

    # n-grams, the longest first
    def count_grams(batches):
        coder, held, size = coder_for(model), [], 0

        def flush():
            grams = np.concatenate(held)
            keys, grams, counts = _distinct(gram_keys(grams), grams, [np.ones(len(grams), np.int64)])
            return _batch(_gram_rows(bits, keys, grams, counts))

        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                numbers, _, lengths = coder.numbers(part.column(1).to_pylist())
                held.append(_grams(numbers, lengths, order, begin).astype(np.uint32))
                size += len(numbers)
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def shorter(grams, counts):
        """What n-grams give to those without their last and without their first word."""
        one, none = np.ones(len(counts), np.int64), np.zeros(len(counts), np.int64)
        less = np.concatenate([grams[:, 1:], grams[:, :-1]])
        values = [np.concatenate(v) for v in zip((one, none, none, none, none), (none, counts, counts == 1, counts == 2, counts >= 3))]
        keys, less, values = _distinct(gram_keys(less), less, values)
        return [(2, shard, data) for shard, data in _gram_rows(bits, keys, less, values)]

    def to_words(grams, counts):
        """The same from pairs to words, by blocks of their numbers."""
        left, right = grams.T.astype(np.int64)
        who, at = np.unique(left, return_inverse=True)
        own = [np.bincount(at, weights=w, minlength=len(who)).astype(np.int64) for w in (counts, counts == 1, counts == 2, counts >= 3)]
        then, following = np.unique(right, return_counts=True)
        out = []
        for kind, ids, columns in ((0, who, own), (1, then, [following])):
            block = np.searchsorted(offsets, ids, side="right") - 1
            block[ids == begin] = -1
            for b in np.unique(block[block >= 0]).tolist():
                here = block == b
                out.append((kind, b, pack(ids[here].astype(U), *(c[here] for c in columns))))
        return out

    def writer(k, discount):
        """Merge shards of n-grams of ``k`` words; ``discount`` is that of one word more."""

        def write(batches):
            for shard, parts in _by_shard(batches, lambda data: unpack_grams(data, k)):
                keys, grams, values = _distinct(*(np.concatenate([p[n] for p in parts]) for n in (0, 1)), [np.concatenate(v) for v in zip(*(p[2] for p in parts))])
                counts = values[0]
                kind = COUNT[max(int(v.max()) for v in values[:2]) >> 32 > 0]  # the file's name tells it
                arrays = [keys, counts.astype(kind)]
                if k < order:
                    total = values[1]
                    arrays += [total.astype(kind), np.where(total > 0, np.tensordot(discount, values[2:], 1) / np.maximum(total, 1), 1.0).astype("<f4")]
                name = _write(folder, f"grams{kind[-1]}-{k}-{shard}", arrays)
                seen = counts > 0  # marks of the beginning alone are histories only
                grams, counts = grams[seen], counts[seen]
                first = counts[(grams[:, -2] == begin)] if k == 2 else counts[:0]
                times = [int((counts == c).sum()) for c in (1, 2, 3, 4)] + [int(x) for x in (first.sum(), (first == 1).sum(), (first == 2).sum(), (first >= 3).sum())] + [len(counts)]
                out = to_words(grams, counts) if k == 2 else shorter(grams, counts)
                rows = [(shard, name, len(keys), times, -1, -1, None), *((None, None, None, None, *o) for o in out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()))], names=["shard", "name", "size", "times", "kind", "block", "data"])

        return write

    rows, before, discount = texts.mapInArrow(count_grams, "shard int, data binary"), None, None
    for k in range(order, 1, -1):
        sums = materialize(dealt(rows, bits).mapInArrow(writer(k, discount), "shard int, name string, size bigint, times array<bigint>, kind int, block int, data binary"), f"lm-sums-{k}", "none")
        if before is not None:
            discard(before)
        listed = sums.where("kind = -1").select("shard", "name", "size", "times").collect()  # a row for each shard
        model.levels[k].names = _names(listed)
        times = np.sum([r["times"] for r in listed], axis=0).astype(float) if listed else np.zeros(9)
        discount = model.discounts[k] = discounts(times[:4].tolist())
        before, rows = sums, sums.where("kind >= 0").select(F.col("block").alias("shard"), "data")
    model.pair_kinds = int(times[8])
    if times[4]:
        model.begin = (float(np.dot(discount, times[5:8]) / times[4]), float(times[4]))

    # statistics of words
    def write_statistics(batches):
        rows = []
        for key, parts in _by_block(batches):
            n, base = int(sizes[key]), int(offsets[key])
            columns = [np.zeros(n, np.int64) for _ in range(5)]
            for ids, *values in parts:
                at = ids.astype(np.int64) - base
                for target, v in zip(columns if len(values) == 4 else columns[4:], values):
                    target[at] += v.astype(np.int64)  # the ids of a row are distinct
            before = columns[4]
            kinds = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before >= 3).sum())]
            name = _write(folder, f"statistics-{key}", [c.astype(t) for c, t in zip(columns, ("<u8", "<u4", "<u4", "<u4", "<u4"))])
            rows.append((key, name, n, kinds))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["shard", "name", "size", "times"])

    written = materialize(dealt(rows, word_bits).mapInArrow(write_statistics, "shard int, name string, size bigint, times array<bigint>"), "lm-statistics")
    discard(before)
    listed = written.collect()
    model.statistics.names = _names(listed)
    times = np.sum([r["times"] for r in listed], axis=0) if listed else np.zeros(5)
    model.discounts[1] = discounts(times[:4].tolist())
    model.low_gamma = float(np.dot(model.discounts[1], [times[0], times[1], times[4]]) / model.pair_kinds) if model.pair_kinds else 1.0
    return model


def _by_block(batches):
    """As :func:`_by_shard`, one row at a time: sums need no gathering."""
    shard, rows = None, None
    pending: list = []
    for batch in batches:
        for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if s != shard and pending:
                yield shard, (unpack(d) for d in pending)
                pending = []
            shard = s
            pending.append(data)
    if pending:
        yield shard, (unpack(d) for d in pending)


def _grams(numbers: np.ndarray, lengths: np.ndarray, order: int, begin: int) -> np.ndarray:
    """The n-gram that ends at each token of texts behind each other; ``begin`` stands for
    what is before a text."""
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(numbers), order), begin, np.int64)
    for back in range(order):
        here = np.flatnonzero(place >= back)
        out[here, order - 1 - back] = numbers[here - back]
    return out


class Coder:
    """Texts to word numbers and counts, remembering recent words."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.reader, self.limit = Reader(model), limit
        self.index: dict[bytes, int] = {}
        self.number = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, count) of each token of all texts, ends included, and the texts' lengths."""
        found = [words_of(t) for t in texts]
        if len(self.index) > self.limit or not self.index:
            self.index, self.number, self.count = {b" end": 0}, *(x for x in self.reader.numbers(np.array([END], U)))
        index = self.index
        fresh = list(set().union(*found).difference(index))
        if fresh:
            number, count = self.reader.numbers(np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), U, len(fresh)))
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            self.number, self.count = np.append(self.number, number), np.append(self.count, count)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
        get, flat = index.__getitem__, []
        for words in found:
            flat += map(get, words)
            flat.append(0)
        at = np.array(flat, np.int64)
        return self.number[at], self.count[at], lengths


def coder_for(model: Model) -> Coder:
    """The coder of this worker for a model, shared by all its tasks."""
    return kept(("lm", model.words.folder, len(model.statistics.names)), lambda: Coder(model))


SCHEMA = "id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every whole text: log10 probabilities
    by add-one counts and by the model. Perplexity is 10 ** (-score / n_tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names and totals of shards

    def run(ids, texts):
        m = shared.value
        coder = coder_for(m)
        number, count, lengths = coder.numbers(texts)
        begins = np.cumsum(lengths) - lengths
        base = np.log10((count + 1) / (m.tokens + m.vocabulary + 1))
        unique, back = np.unique(number, return_inverse=True)
        history, gamma, p = (x[back] for x in coder.reader.word_statistics(unique))
        first = m.begin[1], m.begin[0]
        grams = np.concatenate([_grams(number, lengths, m.order, m.vocabulary), np.full((1, m.order), m.vocabulary)])
        for k in range(2, m.order + 1):
            # the history of a token is the n-gram that ends before it, marks where a text begins
            total, rest = np.empty(len(number)), np.empty(len(number))
            total[1:], rest[1:] = history[: len(number) - 1], gamma[: len(number) - 1]
            total[begins], rest[begins] = first
            count_k, history, gamma = coder.reader.grams(grams[:, -k:])
            first = history[-1], gamma[-1]
            c = count_k[:-1]
            p = np.where(c > 0, (c - discounted(m.discounts[k], c)) / np.maximum(total, 1), 0.0) + rest * p
        total = np.add.reduceat(np.log10(p), begins)
        return {"id": ids, "n_tokens": lengths.tolist(), "n_known": np.add.reduceat((count > 0).astype(np.int64), begins).tolist(), "base_score": np.add.reduceat(base, begins).tolist(), "score": total.tolist()}

    return map_texts(docs, id_col, text_col, SCHEMA, run, max_bytes=2 << 20)

"""N-gram Jaccard join: groups of documents whose shingle sets are similar, exactly.

The join works in the metric space of the Jaccard distance: documents are pivots, every
document has its home in the Voronoi cell of its nearest pivot, and copies of it go to the
cells of other pivots where the triangle inequality leaves a partner possible.

1. Each text becomes its set of hashed word n-grams. Equal sets form a class, and the row
   with the smallest id stands for it, so copies weigh nothing from here on.
2. First cells. A bounded sample of documents, no two of them within twice the join
   distance, are the pivots: so many that a cell is a quarter of what a task may hold, as long
   as they are few enough to be sent along. A document's window are the pivots
   no further than its nearest one by more than twice the join distance. Unrelated texts
   have distance 1 from nearly everything, so windows alone would copy most documents to all
   cells; a copy is made only for a cell at home in which there is a document of fitting
   size that shares enough shingles. That is found by the shingles that a linked pair must
   share ``MEETINGS`` of, in an order that puts frequent ones last (a count by hash bucket
   over all rows decides). Of two cells the pair meets in the one with the smaller number.
3. A region too large for one task is split again: documents sampled from it are pivots of
   cells within it, with windows and copies as before. Documents within the join distance of a pivot
   are linked to it there and then, and a cell in which all are connected needs no more: a
   large group of near copies costs a pass, not its pairs. A region that pivots cannot shrink
   is cut into blocks: of its largest connected part, each with all other documents, or,
   where those are many, all pairs of blocks.
4. Within a region, pivots give distance windows again: two sets whose distances to a pivot
   differ by more than the join distance are not compared, nor are sets already connected.

Distances are compared as whole numbers, so ties at the threshold are exact. Shingles are
64-bit hashes of words.

Null and empty texts have the empty set and are linked with nothing; a text with fewer words
than a shingle has its whole sequence as the only one; very long texts are taken whole. Rows
that share an id are one node. Rows with a null id keep their set size and have a null
component. Repeated rows and ties have one result whatever the order of rows; an empty table
gives an empty result; other columns, whatever their names, are left out first.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from concord.llm._common import Interner, discard, kept, materialize, slices, sum_arrays

U = np.uint64
SKETCH_BITS = 22
MEETINGS = 3


@dataclass(frozen=True)
class Join:
    """``words`` in a shingle; a pair links when ``per`` * intersection >= ``least`` * union.
    ``pivots`` and ``cell_pivots``: documents that cells lie around, at the first level and
    within a region; the first level has up to ``most_pivots`` where the input is large.
    ``cell_shingles`` and ``cell_work`` bound a region for one task: the sum
    of its set sizes, and that times its number of sets. ``group``: documents of a shingle
    beyond which it is dealt over several tasks."""

    words: int = 5
    least: int = 80
    per: int = 100
    cell_shingles: int = 4_000_000
    cell_work: int = 8_000_000_000
    pivots: int = 128
    cell_pivots: int = 16
    group: int = 1 << 14
    most_pivots: int = 4096

    def overlap(self, a, b):
        """The least intersection of linked sets of these sizes."""
        return -(-self.least * (a + b) // (self.least + self.per))

    def distance(self) -> float:
        return 1 - self.least / self.per

    def pivots_for(self, shingles: int, sets: int) -> int:
        """Pivots of the first level, whose mean cell has a quarter of what bounds a region:
        all regions of an input with too few would be split again, text and all."""
        wanted = max(-(-4 * shingles // self.cell_shingles), int(np.ceil(2 * np.sqrt(shingles * sets / self.cell_work))))
        return self.pivots and max(self.pivots, min(wanted, self.most_pivots))


# ---------------------------------------------------------------- sets


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingles."""

    def __init__(self, words: int):
        self.words = words
        self.known = Interner(xxhash.xxh3_64_intdigest, limit=500_000)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        k, get = self.words, self.known.__getitem__
        for text in texts:
            words = text.encode().lower().split() if text else []
            codes = np.fromiter(map(get, words), U, len(words))
            if 0 < len(codes) < k:
                out.append(np.array([xxhash.xxh3_64_intdigest(codes.tobytes(), seed=len(codes))], U))
                continue
            size = max(0, len(codes) - k + 1)
            total = np.zeros(size, U)
            for n in range(k):
                total = total * U(0x9E3779B97F4A7C15) + codes[n : n + size]
                total ^= total >> U(29)
            total *= U(0xBF58476D1CE4E5B9)
            out.append(np.unique(total ^ (total >> U(32))))
        return out


def shingler_for(words: int) -> Shingler:
    """The shingler of this worker, shared by all its tasks."""
    return kept(("jaccard", words), lambda: Shingler(words))


def signatures(docs: DataFrame, join: Join) -> tuple[DataFrame, np.ndarray]:
    """((id, n, h), order): set sizes and 128-bit digests of all rows, and for each hash
    bucket of shingles the logarithm of how many sets hold one of them."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h", pa.binary()), ("key", pa.string()), ("task", pa.int32()), ("data", pa.binary())])
    words = join.words
    keys = 64

    def run(batches):
        shingler, seen = shingler_for(words), set()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                sets = shingler(part.column(1).to_pylist())
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                for s, h in zip(sets, digests):
                    if h not in seen:
                        seen.add(h)
                        sketch[s >> U(64 - SKETCH_BITS)] += 1
                none = [None] * len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *(pa.array(none, t.type) for t in list(schema)[3:])], schema=schema)
        if seen:
            task = TaskContext.get().partitionId()
            rows = [(f"{n:02d}", task, zlib.compress(x.tobytes(), 1)) for n, x in enumerate(np.split(sketch, keys))]
            yield pa.RecordBatch.from_arrays([*(pa.array([None] * keys, t.type) for t in list(schema)[:3]), *(pa.array(c, t.type) for c, t in zip(zip(*rows), list(schema)[3:]))], schema=schema)

    rows = docs.mapInArrow(run, "id bigint, n bigint, h binary, key string, task int, data binary")
    rows = materialize(rows, "jaccard-sets")
    counts = sum_arrays(rows.where("key is not null").select("key", "task", "data"), "<u4", written=True)
    order = np.zeros(1 << SKETCH_BITS, np.uint8)
    if counts:
        total = np.concatenate([a for _, a in counts]).astype(np.float64)
        order = np.ceil(2 * np.log2(total + 1)).astype(np.uint8)
    return rows.where("key is null").select("id", "n", "h"), order


# ---------------------------------------------------------------- pivots and their cells


class Pivots:
    """Sets that a level's regions lie around, with an index of their shingles."""

    def __init__(self, sets: list[np.ndarray], join: Join):
        self.join, self.sizes = join, np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.shingles, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.bits = min(24, max(20, len(flat).bit_length() + 3))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.shingles >> U(64 - self.bits)] = True

    def near(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, pivot, intersection) of all that share a shingle, by set."""
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        here = np.flatnonzero(self.maybe[flat >> U(64 - self.bits)])
        at = np.searchsorted(self.shingles, flat[here])
        at[at == len(self.shingles)] = 0
        hit = self.shingles[at] == flat[here] if len(self.shingles) else np.zeros(len(here), bool)
        here, at = here[hit], at[hit]
        times = self.first[at + 1] - self.first[at]
        row = np.repeat(np.searchsorted(np.cumsum(sizes), here, side="right"), times)
        pivot = self.owner[np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[at], times)]
        key, both = np.unique(row * max(1, len(self.sizes)) + pivot, return_counts=True)
        return key // max(1, len(self.sizes)), key % max(1, len(self.sizes)), both

    def cells(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The home cell of each set, its distance to that pivot, and (set, pivot, distance)
        of all pivots nearer than 1. A set is at home with its nearest pivot, the first of
        equals; one that shares no shingle with any, and so has distance 1 to all, with the
        pivot that its smallest shingle points to, which near copies agree on."""
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        row, pivot, both = self.near(sets)
        distance = 1 - both / (sizes[row] + self.sizes[pivot] - both)
        home = np.array([int(s[0] % U(max(1, len(self.sizes)))) if len(s) else 0 for s in sets], np.int64)
        least = np.ones(len(sets))
        order = np.lexsort((pivot, distance, row))
        first = order[np.diff(row[order], prepend=-1) > 0]
        home[row[first]], least[row[first]] = pivot[first], distance[first]
        return home, least, (row, pivot, distance)

    def windows(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """The cells each set must be in: a set linked to one at home with pivot p is no
        further from p than from its own pivot by more than twice the join distance."""
        home, least, (row, pivot, distance) = self.cells(sets)
        wide = 2 * self.join.distance() + 1e-9
        inside = distance <= least[row] + wide
        out = np.split(pivot[inside], np.searchsorted(row[inside], np.arange(1, len(sets))))
        everywhere = np.arange(max(1, len(self.sizes)))
        return [everywhere if d + wide >= 1 else np.union1d(p, [h]) for p, d, h in zip(out, least.tolist(), home.tolist())]


def net(sets: list[np.ndarray], most: int, join: Join) -> list[int]:
    """Places of at most ``most`` sets, each further than twice the join distance from those before."""
    if not sets:
        return []
    around, chosen, taken = Pivots(sets, join), [], np.zeros(len(sets), bool)
    for start in range(0, len(sets), 64):
        part = sets[start : start + 64]
        row, other, both = around.near(part)
        close = 1 - both / (around.sizes[row + start] + around.sizes[other] - both) <= 2 * join.distance()
        row, other = row[close], other[close]
        bounds = np.searchsorted(row, np.arange(len(part) + 1))
        for n in range(len(part)):
            if len(chosen) == most:
                return chosen
            if not taken[other[bounds[n] : bounds[n + 1]]].any() and not (2 * join.distance() >= 1 and chosen):
                chosen.append(start + n)
                taken[start + n] = True
    return chosen


def first_pivots(rows: DataFrame, classes: DataFrame, join: Join) -> Pivots:
    """Pivots of the first level: a bounded sample of documents of middling size, chosen by hash."""
    size = classes.agg(F.sum("n"), F.count("*")).first()
    wanted = join.pivots_for(size[0] or 0, size[1])
    number = max(4 * join.pivots, 2 * wanted)  # near copies among them fall out
    drawn = classes.where(F.col("n").between(8, 4096)).orderBy(F.xxhash64("h"), "h").limit(number).select(F.col("rep").alias("id"))
    texts = rows.join(F.broadcast(drawn.distinct()), "id").groupBy("id").agg(F.min("text").alias("text")).collect()  # ``number`` documents
    texts = sorted((r for r in texts if r["text"]), key=lambda r: (xxhash.xxh3_64_intdigest(r["text"]), r["id"]))
    sets = [s for s in Shingler(join.words)([r["text"] for r in texts]) if len(s) <= 4096]
    return Pivots([sets[k] for k in net(sets, wanted, join)], join)


#: Bits of a bitmap of ids, and of one row of it.
ID_BITS, ROW_BITS = 25, 15


def parted(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` is surely none of the ``id`` s of ``ids``, those where it may be
    one). A bitmap of hashed ids, 4 MB at most whatever their number, tells them apart, so that
    only the second need be shuffled with their texts to join with ``ids``."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << ID_BITS).cast("bigint"))
    key, bits = "key of a bitmap", "bits of a bitmap"
    marks = ids.select(place(F.col("id").cast("bigint")).alias("p")).groupBy(F.shiftright("p", ROW_BITS).alias(key)).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias(bits))
    own = place(rows[column].cast("bigint"))
    met = rows.withColumn(key, F.shiftright(own, ROW_BITS)).join(F.broadcast(marks), key, "left")
    at = own.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    maybe = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return met.where(~maybe).drop(key, bits), met.where(maybe).drop(key, bits)


MARKED = pa.schema([("shingle", pa.int64()), ("id", pa.int64()), ("info", pa.int64()), ("more", pa.int64()), ("region", pa.int64())])


class Marker:
    """Makes rows (shingle, id, info, more, region): one for each of the shingles of a document
    in which it must meet whatever links to it in its region; ``info`` holds its home cell and
    size. Shingles that more than ``join.group`` documents hold are salted, and each of their
    parts is told (id null) which cells hold them, with the least and (``more``) greatest
    size and a count."""

    def __init__(self, join: Join, rank: np.ndarray):
        self.join, self.rank = join, rank
        self.often = int(np.ceil(2 * np.log2(join.group + 1)))
        self.told: dict[tuple[int, int, int], list[int]] = {}

    def add(self, ids: np.ndarray, sets: list[np.ndarray], home: np.ndarray, region: int) -> pa.RecordBatch:
        join, found = self.join, []
        for s in sets:
            take = min(len(s), len(s) + join.least * len(s) // -join.per + MEETINGS)
            found.append(s[np.argsort(self.rank[s >> U(64 - SKETCH_BITS)], kind="stable")[:take]])
        times = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found) if found else np.zeros(0, U)
        who, info = np.repeat(ids, times), np.repeat(home << 40 | np.fromiter(map(len, sets), np.int64, len(sets)), times)
        height = self.rank[flat >> U(64 - SKETCH_BITS)]
        hot = height >= self.often
        for x, i, h in zip(flat[hot].tolist(), info[hot].tolist(), height[hot].tolist()):
            size = i & (1 << 40) - 1
            one = self.told.setdefault((region, x, i >> 40), [size, size, 0, h])
            one[0], one[1], one[2] = min(one[0], size), max(one[1], size), one[2] + 1
        flat[hot] = _salted(flat[hot], who[hot].astype(U) * U(0x9E3779B97F4A7C15) >> U(32), _parts(height[hot], self.often))
        if region:
            flat ^= U(region & (1 << 64) - 1)
        return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(who), pa.array(info), pa.array(np.zeros(len(flat), np.int64)), pa.array(np.full(len(flat), region, np.int64))], schema=MARKED)

    def tell(self):
        """What the parts of salted shingles are told, of all rows that were added."""
        out = []
        for (region, x, c), (low, high, m, h) in self.told.items():
            parts = int(_parts(np.array([h]), self.often)[0])
            keys = _salted(np.full(parts, x, U), np.arange(parts, dtype=U), np.full(parts, parts, U)) ^ U(region & (1 << 64) - 1)
            out += [(k, None, c << 40 | low, high << 32 | min(m, 2), region) for k in keys.view(np.int64).tolist()]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c_, t.type) for c_, t in zip(zip(*out), MARKED)], schema=MARKED)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c_, t.type) for c_, t in zip(zip(*out), MARKED)], schema=MARKED)
        self.told = {}


def marked(texts: DataFrame, shared, join: Join) -> DataFrame:
    """The rows of a :class:`Marker` for (id, text), which are one region; ``shared``: the
    broadcast order of shingles, 4 MB whatever the input, and pivots, a bounded sample."""

    def run(batches):
        shingler, (rank, around) = shingler_for(join.words), shared.value
        marker = Marker(join, rank)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                sets = shingler(part.column(1).to_pylist())
                yield marker.add(part.column(0).to_numpy(), sets, around.cells(sets)[0], 0)
        yield from marker.tell()

    return texts.mapInArrow(run, "shingle bigint, id bigint, info bigint, more bigint, region bigint")


def _parts(height: np.ndarray, often: int) -> np.ndarray:
    """How many parts a shingle of 2 ** (height / 2) documents is dealt over: 1024 at most, as
    each part is told of the cells by each task."""
    return np.minimum(2.0 ** np.ceil((height.astype(float) - often) / 2 + 1), 1024).astype(U)


def _salted(shingle: np.ndarray, salt: np.ndarray, parts: np.ndarray) -> np.ndarray:
    x = (shingle ^ (salt % np.maximum(parts, U(1)) + U(1)) * U(0xD6E8FEB86659FD93)) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(31))


def replicas(rows: DataFrame, join: Join) -> DataFrame:
    """(region, id, cell): the cells in which a document may have a partner, from marked rows. Of the home cells of two documents that meet, both are in the one with the smaller number.
    Linked documents meet in ``MEETINGS`` shingles, or in all they share if those are fewer."""
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("cell", pa.int32()), ("need", pa.int32())])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = (1 << 40) - 1

    def meet(shingle, ids, known, info, more, region):
        """Rows of whole shingles, or of a part of a salted one behind what is told of it."""
        told = np.isin(shingle, shingle[~known]) if not known.all() else np.zeros(len(shingle), bool)
        tell = ~known | ~told  # what describes the shingle's cells
        cell, low = info[tell] >> 40, info[tell] & size
        high, count = np.where(known[tell], low, more[tell] >> 32), np.where(known[tell], 1, more[tell] & 0xFFFFFFFF)
        by = np.lexsort((cell, shingle[tell]))
        key, cell, low, high, count = shingle[tell][by], cell[by], low[by], high[by], count[by]
        start = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(cell, prepend=-1) != 0))
        low, high, count = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start), np.add.reduceat(count, start)
        key, cell = key[start], cell[start]
        who = np.flatnonzero(known)
        begin, end = np.searchsorted(key, shingle[who]), np.searchsorted(key, shingle[who], side="right")
        alone = (end - begin == 1) & (count[begin] == 1)
        who, begin, end = who[~alone], begin[~alone], end[~alone]
        times = end - begin
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
        who = np.repeat(who, times)
        own, n = info[who] >> 40, info[who] & size
        fits = (join.per * high[at] >= join.least * n) & (join.least * low[at] <= join.per * n) & ((cell[at] != own) | (count[at] > 1))
        at, who, own, n = at[fits], who[fits], own[fits], n[fits]
        need = np.minimum(MEETINGS, join.overlap(n, np.maximum(low[at], -(-join.least * n // join.per))))
        target = np.minimum(cell[at], own)
        by = np.lexsort((need, target, who))
        first = by[(np.diff(who[by], prepend=-1) != 0) | (np.diff(target[by], prepend=-1) != 0)]
        return pa.RecordBatch.from_arrays([pa.array(region[who[first]]), pa.array(ids[who[first]]), pa.array(target[first].astype(np.int32)), pa.array(need[first].astype(np.int32))], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_ = batch.column(1)
            now = [batch.column(0).to_numpy(), id_.fill_null(0).to_numpy(), np.asarray(id_.is_valid()), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            open_ = int(np.searchsorted(now[0], now[0][-1]))  # rows are sorted by shingle
            if not now[2][open_]:  # a salted part: what is told of it stands first, the rest can go
                yield meet(*now)
                stay = np.arange(len(now[0])) >= open_
                held = [x[stay & ~now[2]] for x in now]
            else:
                if open_:
                    yield meet(*(x[:open_] for x in now))
                held = [x[open_:] for x in now]
        if held is not None and held[2].any():
            yield meet(*held)

    dealt = rows.repartition(parts, "shingle").sortWithinPartitions("shingle", "id")
    met = dealt.select("shingle", "id", "info", "more", "region").mapInArrow(run, "region bigint, id bigint, cell int, need int")
    return met.groupBy("region", "id", "cell").agg(F.count("*").alias("met"), F.min("need").alias("need")).where("met >= need").select("region", "id", "cell")


def first_cells(members: DataFrame, shared, join: Join) -> DataFrame:
    """(region, id, n, above, text, root) of (id, cell, text): those in the triangle inequality's windows."""
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("above", pa.int64()), ("text", pa.string()), ("root", pa.int64())])

    def run(batches):
        shingler = shingler_for(join.words)
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                sets = shingler(part.column(2).to_pylist())
                cell = part.column(1).to_numpy()
                home, least, (row, pivot, distance) = shared.value[1].cells(sets)
                here = np.ones(len(sets))
                mine = pivot == cell[row]
                here[row[mine]] = distance[mine]
                inside = (here <= least + 2 * join.distance() + 1e-9) | (home == cell)
                n, none = pa.array([len(s) for s in sets], pa.int64()), pa.array([None] * len(sets), pa.int64())
                whole = pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), part.column(0), n, none, part.column(2), none], schema=schema)
                yield whole.filter(pa.array(inside))

    return members.select("id", "cell", "text").mapInArrow(run, "region bigint, id bigint, n bigint, above bigint, text string, root bigint")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): connected components by alternating large and small stars; the root is
    the smallest node. Each round is written to the shared folder."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), tag)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        before, edges = edges, materialize(small, tag)
        # settled when every node has one edge and no root has one: stars, which stay as they are
        more = edges.groupBy("u").count().where("count > 1").limit(1).count()
        done = not more and not edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        discard(before)
        if done:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    out.shared_folder = edges.shared_folder
    return out


# ---------------------------------------------------------------- joining


def intersections(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    return np.array([len(np.intersect1d(one, o, assume_unique=True)) for o in others], np.int64)


def join_sets(ids: list[int], sets: list[np.ndarray], join: Join, labels: list[int | None] | None = None) -> list[tuple[int, int]]:
    """(id, smallest id of its group) of the members of all groups of linked sets. Those of
    equal ``labels`` are known to be connected and not compared with each other."""
    count = len(ids)
    sizes = np.fromiter(map(len, sets), np.int64, count)
    owner = np.repeat(np.arange(count), sizes)
    shingles, term, times = np.unique(np.concatenate(sets) if count else np.zeros(0, U), return_inverse=True, return_counts=True)
    shared = times[term] > 1
    owner, term = owner[shared], term[shared]
    by_term = np.argsort(term, kind="stable")
    listed = owner[by_term]
    starts = np.searchsorted(term[by_term], np.arange(len(shingles) + 1))
    own_start = np.searchsorted(owner, np.arange(count + 1))
    popularity = np.bincount(owner, weights=times[term], minlength=count)
    root = np.arange(count)
    first_of: dict[int, int] = {}
    for n, i in enumerate(ids):  # rows that share an id are one node
        root[n] = first_of.setdefault(i, n)
    known: dict[int, int] = {}
    for n, label in enumerate(labels or ()):
        if label is not None and known.setdefault(label, root[n]) != root[n]:
            root[root == root[n]] = known[label]

    def overlaps(x: int) -> np.ndarray:
        terms = term[own_start[x] : own_start[x + 1]]
        length = starts[terms + 1] - starts[terms]
        if not len(terms):
            return np.zeros(count, np.int64)
        at = np.repeat(starts[terms] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return np.bincount(listed[at], minlength=count)

    order = np.argsort(-popularity, kind="stable")
    windows = []
    for x in order[:3].tolist():  # pivots
        both = overlaps(x)
        union = sizes + sizes[x] - both
        windows.append(1 - both / np.maximum(union, 1))
    limit = join.distance() + 1e-9
    most = np.bincount(root, minlength=count).argmax() if count else 0
    for x in order[root[order] != most].tolist():  # what the largest group links to is found from the other side
        maybe = (root != root[x]) & (join.per * np.minimum(sizes, sizes[x]) >= join.least * np.maximum(sizes, sizes[x]))
        for d in windows:
            maybe &= np.abs(d - d[x]) <= limit
        if not maybe.any():
            continue
        both = overlaps(x)
        linked = maybe & (join.per * both >= join.least * (sizes + sizes[x] - both)) & (both > 0)
        if linked.any():
            joined = np.unique(np.append(root[linked], root[x]))
            root[np.isin(root, joined)] = joined[0]
    names = np.array(ids, np.int64)
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, root, names)
    grouped = np.bincount(root, minlength=count)[root] > 1
    return list(zip(names[grouped].tolist(), least[root][grouped].tolist()))


def _join_regions(rows: DataFrame, join: Join) -> DataFrame:
    """Links (id, root) within regions of (region, id, text, root: what it is connected to
    already); a region fits one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64())])

    def run(batches):
        shingler = shingler_for(join.words)
        region, ids, sets, labels = None, [], [], []

        def flush():
            links = join_sets(ids, sets, join, labels)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for part in slices(batch, 2, 8 << 20):
                names = part.column(0).to_pylist()
                for r, i, s, label in zip(names, part.column(1).to_pylist(), shingler(part.column(2).to_pylist()), part.column(3).to_pylist()):
                    if r != region and ids:
                        yield flush()
                        ids, sets, labels = [], [], []
                    region = r
                    ids.append(i)
                    sets.append(s)
                    labels.append(label)
        if ids:
            yield flush()

    return rows.select("region", "id", "text", "root").repartition(parts, "region").sortWithinPartitions("region", "id").mapInArrow(run, "id bigint, root bigint")


SPLIT = "region bigint, id bigint, n bigint, above bigint, text string, root bigint, window array<int>, shingle bigint, info bigint, more bigint"


def _split(rows: DataFrame, drawn: DataFrame, shared, join: Join) -> DataFrame:
    """Of regions (region, id, s, text): documents with the cells of their ``window`` (null:
    all), links to drawn documents (``root`` set), and marked rows (``info`` set). A region's rows are
    dealt over several tasks, each of which gets the region's drawn documents first; those
    that lie apart are the pivots."""
    schema = to_arrow_schema(_parse_datatype_string(SPLIT))
    salts = 16

    def rows_of(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def as_marked(batch):
        return rows_of(shingle=batch.column(0), id=batch.column(1), info=batch.column(2), more=batch.column(3), region=batch.column(4))

    def run(batches):
        shingler, marker = shingler_for(join.words), Marker(join, shared.value[0])
        key, waiting, around, centres = None, [], None, None
        for batch in batches:
            for part in slices(batch, 5, 4 << 20):
                sets = shingler(part.column(5).to_pylist())
                keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                first, ids, above = part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist()
                starts = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1] or first[n] != first[n - 1]), len(keys)]
                for a, b in zip(starts, starts[1:]):
                    if keys[a] != key:
                        key, waiting, around = keys[a], [], None
                    if first[a]:
                        waiting += zip(ids[a:b], sets[a:b])
                        continue
                    if around is None:
                        centres = Pivots([x for _, x in waiting], join)
                        around = Pivots([waiting[k][1] for k in net([x for _, x in waiting], join.cell_pivots, join)], join)
                    own, who = sets[a:b], np.array(ids[a:b], np.int64)
                    sizes = np.fromiter(map(len, own), np.int64, len(own))
                    row, centre, both = centres.near(own)
                    names = np.array([i for i, _ in waiting], np.int64)
                    linked = join.per * both >= join.least * (sizes[row] + centres.sizes[centre] - both)
                    linked &= who[row] != names[centre] if len(names) else False
                    yield rows_of(id=who[row[linked]], root=names[centre[linked]] if len(names) else np.zeros(0, np.int64))
                    windows = [None if len(w) >= len(around.sizes) else w.tolist() for w in around.windows(own)]
                    yield rows_of(region=np.full(b - a, key[0]), id=who, n=sizes, above=above[a:b], text=part.column(5).slice(a, b - a), window=windows)
                    yield as_marked(marker.add(who, own, around.cells(own)[0], key[0]))
        for told in marker.tell():
            yield as_marked(told)

    salted = rows.select("region", F.pmod(F.xxhash64("id"), F.lit(salts).cast("bigint")).alias("salt"), F.lit(False).alias("first"), "id", F.col("s").alias("above"), "text")
    everywhere = drawn.select("region", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), F.lit(True).alias("first"), "id", F.lit(None).cast("bigint").alias("above"), "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted.unionByName(everywhere).repartition(parts, "region", "salt").sortWithinPartitions("region", "salt", F.desc("first"), "id")
    return dealt.mapInArrow(run, SPLIT)


def _blocks(rows: DataFrame, join: Join) -> DataFrame:
    """Regions that pivots cannot shrink, as (region, id, text, root). Where most documents are
    connected already, they are dealt over blocks and each block gets all the others; else
    every pair of blocks is a region."""
    number = F.greatest(F.lit(2), F.ceil(2 * F.greatest(F.col("s") / join.cell_shingles, F.sqrt(F.col("s") * F.col("m") / join.cell_work)))).cast("bigint")
    groups = rows.groupBy("region", "root").agg(F.sum("n").alias("part")).groupBy("region").agg(F.max_by("root", "part").alias("main"), (F.sum("part") - F.max("part")).alias("rest"))
    block, every = F.pmod(F.xxhash64("id"), number), F.sequence(F.lit(0).cast("bigint"), number - 1)
    few = F.col("rest") <= join.cell_shingles / 4
    placed = rows.join(groups, "region").withColumn("block", block).withColumn("few", few)
    placed = placed.withColumn("other", F.explode(F.when(F.col("few") & (F.col("root") == F.col("main")), F.array("block")).otherwise(every)))
    name = F.when(F.col("few"), F.xxhash64("region", "other")).otherwise(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")))
    return placed.select(name.alias("region"), "id", "text", "root")


def _region_links(cells: DataFrame, shared, join: Join) -> DataFrame:
    """Links (id, root) of all regions, which are named by hashes of where they come from. Those too large for a task are split around pivots of
    their own until none is; a region whose documents are connected already needs no more."""
    links = None

    def add(found: DataFrame) -> None:
        nonlocal links
        before, links = links, materialize(found if links is None else links.union(found), "jaccard-links")
        if before is not None:
            discard(before)

    while True:
        sizes = cells.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.first("above").alias("over"))
        large = materialize(sizes.where((F.col("s") > join.cell_shingles) | (F.col("s") * F.col("m") > join.cell_work)), "jaccard-large")
        number = large.count()
        if not number and links is None:
            return _join_regions(cells, join)
        if not number:
            add(_join_regions(cells, join))
            return links
        chosen = F.broadcast(large) if number <= 10_000 else large  # a checked size; a join by region beyond it
        shrinks = F.col("over").isNull() | (F.col("s") <= 0.7 * F.col("over"))
        rows = cells.drop("above").join(chosen, "region")
        small = cells.join(chosen, "region", "left_anti").select("region", "id", "text", "root")
        add(_join_regions(small.unionByName(_blocks(rows.where(~shrinks), join)), join))
        rows = rows.where(shrinks)
        share = F.greatest(F.lit(1).cast("bigint"), (F.col("m") / (8 * join.cell_pivots)).cast("bigint"))
        place = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("id"), "id"))
        drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), share) == 0).withColumn("k", place).where(F.col("k") <= 4 * join.cell_pivots)
        split = materialize(_split(rows, drawn, shared, join), "jaccard-split")
        add(split.where("root is not null").select("id", "root"))
        labels = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), "jaccard-groups")
        members = replicas(split.where("info is not null").select("shingle", "id", "info", "more", "region"), join)
        below = split.where("n is not null").drop("root").join(members, ["region", "id"]).where(F.col("window").isNull() | F.array_contains("window", F.col("cell")))
        below = below.join(labels.withColumnRenamed("node", "id"), "id", "left")
        below = below.select(F.xxhash64("region", "cell").alias("region"), "id", "n", "above", "text", F.coalesce("root", "id").alias("root"))
        # documents that are connected already need not be compared with each other
        open_ = below.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("region")
        before, cells = cells, materialize(below.join(open_, "region", "left_semi"), "jaccard-cells")
        discard(split, large, labels, before)


def similar(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set, and the smallest id
    that links reach from it."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets, order = signatures(rows, join)
    classes = sets.where("n > 0 and id is not null").groupBy("h").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    classes = materialize(classes, "jaccard-classes")
    pivots = first_pivots(rows, classes, join)
    # texts are shuffled only where a bitmap leaves open whether they are needed; these joins
    # are merged at every size: what a small table could broadcast is as long as the table
    reps = classes.select(F.col("rep").alias("id")).distinct()
    copies = sets.where("n > 0 and id is not null").select("id").distinct().join(reps.hint("merge"), "id", "left_anti")
    known = rows.where("id is not null and text is not null")
    sure, maybe = parted(known, "id", copies)
    texts = sure.unionByName(maybe.join(reps.hint("merge"), "id").select("id", "text"))
    shared = rows.sparkSession.sparkContext.broadcast((order, pivots))
    members = materialize(replicas(marked(texts, shared, join), join).drop("region"), "jaccard-members")
    _, maybe = parted(known, "id", members)
    inside = maybe.join(members.hint("merge"), "id").select("id", "cell", "text")
    cells = materialize(first_cells(inside, shared, join), "jaccard-cells")
    links = _region_links(cells, shared, join)
    labels = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), "jaccard-groups").select(F.col("node").alias("id"), "root")
    discard(members, links)
    named = classes.join(labels, classes["rep"] == labels["id"], "left").select("h", F.coalesce("root", "rep").alias("root"))
    # rows with nothing to link need no partner, and would all meet in one task
    joined = sets.where("n > 0").join(named, "h", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("root")).alias("root"))
    return joined.unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("root"))).select("id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def representatives(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand for their group: those with its smallest
    id. Rows with an empty set or a null id stay; rows that repeat the id of one stay with it."""
    found = similar(docs, join, id_col, text_col)
    others = materialize(found.where("component_id != id").select("id").distinct(), "jaccard-others")
    sure, maybe = parted(docs, id_col, others)
    return sure.unionByName(maybe.join(others.hint("merge"), maybe[id_col].cast("bigint") == others["id"], "left_anti"))

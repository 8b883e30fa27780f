"""Spelling variants: frequent words and the rare forms one edit away from them.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced
code point turns one into the other; a word's form is its near word that is most frequent, if
it is frequent enough, and its root is where forms lead in the end.

Near words are found with blocks of letter counts. One edit moves a word's letter counts by a
squared distance of one (length one apart) or two (same length), or not at all, where the
letters share a column. Squared distances of a whole block of words to another come from one
NumPy product of count matrices; pairs at most two apart are verified by comparing code
points. A block is a length and, to keep blocks small whatever the vocabulary, the number of
letters of each of ``classes`` classes of letters; an edit moves these by one at most in one
class, or from one class to another, so a word meets its own block and the adjacent ones, and
each pair of blocks meets once. Blocks of more than ``block_words`` words are cut by a hash of
the word. A task streams over the words that visit a block and holds the block alone.

The result is exact. Null and empty texts have no words; null ids read as ``null`` in the
hash; repeated rows are counted again; a word as long as its text is one word like others.
Of near words with the same count the smallest in code-point order is the form. An empty
table gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm._common import slices
from concord.sources.paths import discard, materialize

#: Letters by how often languages of Latin script use them; dealt to the classes in turn.
FREQUENT = "eaionrtsludcmpgbvhfqyzxjkw"
#: Columns of a letter-count matrix: one for each of a-z, the other code points share the rest.
COLUMNS = 32
#: Rows of a product of two blocks.
PRODUCT_ROWS = 2048


@dataclass(frozen=True)
class Rules:
    """``shortest``: code points of a word; ``least``: occurrences of a word; ``ratio``: how
    many times as frequent a form is; ``noise``: one of so many runs loses a code point, by
    its hash (0: none). ``classes`` and ``block_words`` bound blocks."""

    shortest: int = 7
    least: int = 2
    ratio: int = 10
    noise: int = 31
    classes: int = 6
    block_words: int = 2048


def count_runs(runs: Counter, key: bytes, rules: Rules, out: Counter) -> None:
    """Add a text's lower-cased runs to ``out``, of each that the hash picks without one code point."""
    start = zlib.crc32(key)
    for run, n in runs.items():
        if rules.noise:
            h = zlib.crc32(run.encode(), start)
            if h % rules.noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < rules.shortest:
                    continue
        out[run] += n


def words(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with enough occurrences in all texts."""
    rules = rules or Rules()
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % rules.shortest)  # shorter runs never make a word

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                found: Counter = Counter()
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        lower = text.encode().lower().decode()  # bytes: A-Z only
                        count_runs(Counter(pattern.findall(lower)), f"{'null' if i is None else i}:".encode(), rules, found)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.least)


# ---------------------------------------------------------------- blocks


def letter_classes(classes: int) -> list[str]:
    """Letters of all classes but the last, which has every other code point."""
    dealt = [""] * classes
    for k, letter in enumerate(FREQUENT):
        turn, at = divmod(k, classes)
        dealt[at if turn % 2 == 0 else classes - 1 - at] += letter
    return dealt[:-1]


def block_of(word: Column, classes: int) -> Column:
    """array<int>: how many code points of each class."""
    length = F.length(word)
    own = [(length - F.length(F.translate(word, letters, ""))) for letters in letter_classes(classes)]
    rest = length
    for c in own:
        rest = rest - c
    return F.array(*own, rest)


def steps(classes: int) -> list[tuple[int, ...]]:
    """From a block to the adjacent ones, one of each pair of opposite steps."""
    unit = np.eye(classes, dtype=int)
    out = [unit[i] for i in range(classes)] + [unit[i] - unit[j] for i in range(classes) for j in range(i + 1, classes)]
    return [tuple(map(int, v)) for v in out]


def _name(block: Column) -> Column:
    return F.concat_ws(".", F.transform(block, lambda v: v.cast("string")))


def meetings(vocabulary: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(block string, part int, home boolean, word, n): every word where it lives and in all
    parts of blocks that it visits; and the written table of blocks that this reads."""
    named = vocabulary.select("word", "n", block_of(F.col("word"), rules.classes).alias("counts")).withColumn("own", _name(F.col("counts")))
    # a block has at most so many words, and letters: words of a block are of one length
    bound = F.greatest(F.lit(1), F.least(F.lit(rules.block_words), F.floor(F.lit(1 << 22) / F.aggregate("counts", F.lit(0), lambda a, v: a + v))))
    blocks = named.groupBy("own", "counts").agg(F.count(F.lit(1)).alias("held")).select("own", "counts", F.ceil(F.col("held") / bound).cast("int").alias("parts"))
    blocks = materialize(blocks, "spelling-blocks")
    near = F.array(*(F.array(*map(F.lit, s)) for s in steps(rules.classes)))
    reached = blocks.select("own", F.explode(F.transform(near, lambda s: F.zip_with("counts", s, lambda a, b: a + b))).alias("counts")).where(F.forall("counts", lambda v: v >= 0))
    visits = reached.select("own", _name(F.col("counts")).alias("block")).join(blocks.select(F.col("own").alias("block"), "parts"), "block")
    at_home = blocks.select("own", F.col("own").alias("block"), "parts")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    home = named.drop("counts").join(at_home, "own").select("block", part.alias("part"), F.explode(F.sequence(part, F.col("parts") - 1)).alias("to"), "word", "n")
    home = home.select("block", F.col("to").alias("part"), (F.col("to") == F.col("part")).alias("home"), "word", "n")  # and later parts of its own block
    away = named.drop("counts").join(visits, "own").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("home"), "word", "n")
    return home.unionByName(away), blocks


# ---------------------------------------------------------------- products of blocks


class Letters:
    """Words as code points in one row each (padded with 0), and their letter counts."""

    def __init__(self, names: list[str]):
        self.names = np.array(names, dtype=object)
        self.length = np.array([len(w) for w in names])
        wide = int(self.length.max())
        codes = np.frombuffer("".join(w.ljust(wide, "\0") for w in names).encode("utf-32-le"), dtype="<u4").reshape(-1, wide)
        self.codes = codes.astype(np.uint16) if codes.max() < 1 << 16 else codes
        column = np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (COLUMNS - 26))
        counts = np.zeros((len(names), COLUMNS), np.float32)
        row, at = np.nonzero(codes)
        np.add.at(counts, (row, column[row, at]), 1)
        self.counts, self.norm = counts, (counts * counts).sum(axis=1)


def close(a: Letters, b: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose letter counts have a squared distance of two at most.
    |x|^2 + |y|^2 - 2 x'y of all pairs of a block in one product; whole numbers, so exact
    below 2^24, and counts beyond are compared in double precision."""
    kind = np.float64 if max(a.norm.max(), b.norm.max()) > 1 << 21 else np.float32
    left = np.column_stack([a.counts, a.norm, np.ones(len(a.norm))]).astype(kind)
    right = np.column_stack([-2 * b.counts, np.ones(len(b.norm)), b.norm]).astype(kind)
    found = [np.nonzero(left[at : at + PRODUCT_ROWS] @ right.T <= 2.5) for at in range(0, len(left), PRODUCT_ROWS)]
    return np.concatenate([i + k * PRODUCT_ROWS for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def one_edit(a: Letters, b: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (row i of a, row j of b) differ by exactly one insertion, deletion or replacement."""
    out = np.zeros(len(i), bool)
    gap = a.length[i] - b.length[j]
    step = max(1, (1 << 22) // max(a.codes.shape[1], b.codes.shape[1]))
    for at in range(0, len(i), step):
        part = slice(at, at + step)
        for difference in (-1, 0, 1):
            mine = np.flatnonzero(gap[part] == difference) + at
            if not len(mine):
                continue
            x, y = a.codes[i[mine]], b.codes[j[mine]]
            if difference < 0:
                x, y = y, x
            if difference == 0:
                wide = min(x.shape[1], y.shape[1])  # beyond is padding: lengths are equal
                out[mine] = (x[:, :wide] != y[:, :wide]).sum(axis=1) == 1
            else:  # x is longer by one: what agrees in front and, moved by one, behind covers y
                wide = min(x.shape[1] - 1, y.shape[1])
                size = np.minimum(a.length[i[mine]], b.length[j[mine]])
                inside = np.arange(wide) < size[:, None]
                front = np.logical_and.accumulate((x[:, :wide] == y[:, :wide]) & inside, axis=1).sum(axis=1)
                # from the end: padding counts as agreeing
                behind = np.logical_and.accumulate(((x[:, 1 : wide + 1] == y[:, :wide]) | ~inside)[:, ::-1], axis=1).sum(axis=1) - (wide - size)
                out[mine] = front + behind >= size
    return out


PAIRS = "a string, a_n bigint, b string, b_n bigint"


def _near(batches):
    """Near pairs of each block's words among each other and with its visitors; rows are
    sorted by block and part, those at home first. Only one block is held."""
    key, names, counts, own, own_n = None, [], [], None, None

    def pairs(a, a_n, b, b_n, upper):
        i, j = close(a, b)
        if upper:
            i, j = i[i < j], j[i < j]
        good = one_edit(a, b, i, j)
        i, j = i[good], j[good]
        return pa.RecordBatch.from_arrays([pa.array(a.names[i], pa.string()), pa.array(a_n[i], pa.int64()), pa.array(b.names[j], pa.string()), pa.array(b_n[j], pa.int64())], names=["a", "a_n", "b", "b_n"])

    def settled():
        nonlocal own, own_n
        if names and own is None:
            own, own_n = Letters(names), np.array(counts, dtype=np.int64)
            if len(names) > 1:
                yield pairs(own, own_n, own, own_n, True)

    for batch in batches:
        blocks, parts, homes = (np.array(batch.column(c).to_pylist()) for c in ("block", "part", "home"))
        if not len(blocks):
            continue
        new = np.flatnonzero((blocks[1:] != blocks[:-1]) | (parts[1:] != parts[:-1]) | (homes[1:] != homes[:-1])) + 1
        word, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        for start, stop in zip([0, *new.tolist()], [*new.tolist(), len(blocks)]):
            here = (blocks[start], parts[start])
            if here != key:
                yield from settled()
                key, names, counts, own, own_n = here, [], [], None, None
            if homes[start]:
                names += word[start:stop]
                counts += n[start:stop]
            elif names:
                yield from settled()
                step = max(1, (1 << 22) // max(map(len, word[start:stop])))
                for at in range(start, stop, step):
                    end = min(stop, at + step)
                    yield pairs(Letters(word[at:end]), np.array(n[at:end], dtype=np.int64), own, own_n, False)
    yield from settled()


def near_pairs(vocabulary: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words of (word, n), once. Its attribute ``scratch``
    is a written table that it reads."""
    met, blocks = meetings(vocabulary, rules or Rules())
    dealt = met.select("block", "part", "home", "word", "n").repartition("block", "part").sortWithinPartitions("block", "part", F.desc("home"))
    out = dealt.mapInArrow(_near, PAIRS)
    out.scratch = blocks
    return out


def group(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts."""
    rules = rules or Rules()
    if rules.ratio < 2 or rules.least < 1 or rules.shortest < 1:
        raise ValueError("ratio must be 2 at least, least and shortest 1")
    vocabulary = materialize(words(docs, rules, id_col, text_col), "spelling-words")
    pairs = near_pairs(vocabulary, rules)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    each = pairs.select(F.explode(sides).alias("e")).select("e.*")
    found = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = vocabulary.join(found, "word", "left")
    best_n = -F.col("best.less")
    enough = best_n >= rules.ratio * F.col("n")
    forms = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, best_n).alias("form_n"))
    forms = materialize(forms, "spelling-forms")
    discard(vocabulary, pairs.scratch)
    return _rooted(forms, rules)


def _rooted(forms: DataFrame, rules: Rules) -> DataFrame:
    """``forms`` with ``root``. Counts grow by ``ratio`` at each step, which bounds the steps."""
    most = forms.where("form is not null").agg(F.max("form_n")).first()[0] or 0
    up = forms.where("form is not null").select(F.col("word").alias("_word"), F.col("form").alias("_form"))
    out = forms.withColumn("root", F.coalesce("form", "word"))
    reach = rules.least * rules.ratio  # the form of the rarest word has so many occurrences at least
    while reach * rules.ratio <= most:  # its form in turn ten times as many
        reach *= rules.ratio
        out = out.join(up, F.col("root") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("_form", "root").alias("root"))
    return out

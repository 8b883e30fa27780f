"""BPE encoding and decoding with the vocabularies of public tokenizers.

Merging keeps a segment tree over the ranks of adjacent pairs: the root yields the
leftmost lowest-rank merge, and a merge changes three leaves, each a logarithmic path,
until no mergeable pair remains. :class:`Tree` does this for one long word;
``Encoder._merge_many`` keeps one tree per row of a matrix and merges many short words in
step. Words recur, so each worker remembers the ids of recent white-space-free chunks.

Null texts are empty: no ids, and the empty text on decoding. Null ids are kept; repeated
rows are encoded again; very long texts are encoded whole; an empty table gives an empty
result; other columns, whatever their names, are left out first. Special tokens that occur in a text become their own ids, as the
tokenizers library has it by default.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame

from concord.llm._common import kept, map_texts

NONE = np.int64(1) << 60


def byte_alphabet() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(own)))
    return [out[b] for b in range(256)]


class Tree:
    """A minimum tree over pair keys ``rank * width + position`` of one word."""

    def __init__(self, keys: list[int]):
        self.size = 1
        while self.size < len(keys):
            self.size *= 2
        none = int(NONE)
        self.node = [none] * self.size + keys + [none] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def set(self, i: int, key: int) -> None:
        node, i = self.node, i + self.size
        node[i] = key
        i //= 2
        while i:
            best = node[2 * i] if node[2 * i] < node[2 * i + 1] else node[2 * i + 1]
            if node[i] == best:
                break
            node[i] = best
            i //= 2


class Encoder:
    """Reads the JSON of a tokenizers file (BPE model); ``spec`` is its text."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a plain BPE model is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.decoder = (spec.get("decoder") or {}).get("type")
        normalizers = spec.get("normalizer") or {}
        normalizers = normalizers.get("normalizers", [normalizers] if normalizers else [])
        kinds = [n["type"] for n in normalizers]
        if [k for k in kinds if k not in ("NFC", "Replace", "Lowercase")]:
            raise ValueError(f"normalizers {kinds} are not supported")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        splits = [p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"]
        if not splits or not self.suffix:
            raise ValueError("words split by a pattern, with an end-of-word suffix, are needed")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self.symbol = np.array([self.vocab[a] for a in alphabet], dtype=np.int64)
        self.last = np.array([self.vocab[a + self.suffix] for a in alphabet], dtype=np.int64)
        vocab = self.vocab
        keys, ranks, made = [], [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(vocab[a] << 32 | vocab[b])
            ranks.append(rank)
            made.append(vocab[a + b])
        self.pairs = dict(zip(keys, zip(ranks, made)))
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], NONE)
        self.ranks = np.append(np.array(ranks, dtype=np.int64)[order], NONE)
        self.made = np.append(np.array(made, dtype=np.int64)[order], -1)
        tokens = {i: t for t, i in {**vocab, **self.special}.items()}
        self.tokens = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        self.decimals = [str(i).encode() for i in range(len(self.tokens))]
        self.whole = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.special.items()}
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = dict(self.whole)
        self.limit = 400_000

    # ------------------------------------------------------------ words

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk of raw text, normalised."""
        if not chunk.isascii():
            if self.nfc:
                chunk = unicodedata.normalize("NFC", chunk)
            if self.lower:
                chunk = chunk.replace("Σ", "σ")  # letter by letter: no final sigma
        if self.lower:
            chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.ranks[at], at

    def merge_one(self, word: bytes) -> list[int]:
        """The ids of one word, by a segment tree of its own."""
        ids = self.symbol[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n, pairs, none = len(ids), self.pairs, int(NONE)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int) -> int:
            found = pairs.get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            return none if found is None else found[0] * n + i

        tree = Tree([key(i) for i in range(n)])
        while (best := tree.root()) != none:
            i = best % n
            j = after[i]
            ids[i] = pairs[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            tree.set(j, none)
            tree.set(i, key(i))
            if before[i] >= 0:
                tree.set(before[i], key(before[i]))
        return [x for x in ids if x >= 0]

    def _merge_many(self, words: list[bytes], width: int) -> np.ndarray:
        """Ids of words of at most ``width`` bytes (a power of two): a matrix with -1 in
        the place of merged symbols. Row r of ``levels`` is the segment tree of word r."""
        count = len(words)
        lengths = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(count, width)
        ids = self.symbol[raw]
        rows = np.arange(count)
        ids[rows, lengths - 1] = self.last[raw[rows, lengths - 1]]
        place = np.arange(width)
        ids[place >= lengths[:, None]] = -1
        after = np.minimum(place + 1, width) * np.ones((count, 1), np.int64)
        before = (place - 1) * np.ones((count, 1), np.int64)
        leaf = np.full((count, width), NONE)
        valid = place[:-1] + 1 < lengths[:, None]
        r, c = np.nonzero(valid)
        rank, _ = self._lookup(ids[r, c], ids[r, c + 1])
        leaf[r, c] = np.where(rank == NONE, NONE, rank * width + c)
        levels = [leaf]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))

        def put(r, at, key):
            levels[0][r, at] = key
            for below, level in zip(levels, levels[1:]):
                at = at >> 1
                level[r, at] = np.minimum(below[r, 2 * at], below[r, 2 * at + 1])

        def keys(r, at):
            to = after[r, at]
            inside = to < lengths[r]
            out = np.full(len(r), NONE)
            rank, _ = self._lookup(ids[r[inside], at[inside]], ids[r[inside], to[inside]])
            out[inside] = np.where(rank == NONE, NONE, rank * width + at[inside])
            return out

        active = rows
        while True:
            root = levels[-1][active, 0]
            active, root = active[root != NONE], root[root != NONE]
            if not len(active):
                return ids
            i = root % width
            j = after[active, i]
            _, at = self._lookup(ids[active, i], ids[active, j])
            ids[active, i] = self.made[at]
            ids[active, j] = -1
            beyond = after[active, j]
            after[active, i] = beyond
            inner = beyond < lengths[active]
            before[active[inner], beyond[inner]] = i[inner]
            put(active, j, NONE)
            put(active, i, keys(active, i))
            left = before[active, i]
            has = left >= 0
            if has.any():
                put(active[has], left[has], keys(active[has], left[has]))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes each; short words together, long ones one by one."""
        out: list = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            if len(w) > 64:
                out[n] = np.array(self.merge_one(w), dtype="<u4").tobytes()
            else:
                classes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(n)
        for width, members in classes.items():
            for at in range(0, len(members), 20_000):
                part = members[at : at + 20_000]
                table = self._merge_many([words[n] for n in part], width)
                flat = table[table >= 0].astype("<u4").tobytes()
                end = (4 * np.cumsum((table >= 0).sum(axis=1))).tolist()
                start = 0
                for n, stop in zip(part, end):
                    out[n] = flat[start:stop]
                    start = stop
        return out

    # ------------------------------------------------------------ texts

    def _chunks(self, text: str) -> list[str]:
        """White-space-free pieces; special tokens stand alone where they occur."""
        split = _split_exact if _ODD.search(text) else str.split
        if self.marks is None or not self.marks.search(text):
            return split(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += split(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + split(text[at:])

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text (null: empty) as unsigned 32-bit numbers."""
        cache = self.cache
        chunked = [self._chunks(t) if t else [] for t in texts]
        fresh = set().union(*chunked).difference(cache)
        if len(cache) + len(fresh) > self.limit:
            cache.clear()
            fresh = set().union(*chunked)
        found = {c: [c] if c in self.special else self.words(c) for c in fresh}
        known = self.known
        new = set().union(*found.values()).difference(known)
        if len(known) + len(new) > self.limit:
            known.clear()
            known |= self.whole
            new = set().union(*found.values()).difference(known)
        new = list(new)
        known.update(zip(new, self.merge([w.encode() for w in new])))
        for chunk, words in found.items():
            cache[chunk] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        return [np.frombuffer(b"".join(map(cache.__getitem__, chunks)), dtype="<u4") for chunks in chunked]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids, skip_special_tokens: bool = False) -> str:
        """What the tokenizers library's ``decode`` gives for a file without a decoder:
        the tokens, joined by spaces."""
        if self.decoder is not None:
            raise ValueError(f"decoder {self.decoder} is not supported")
        drop = set(self.special.values()) if skip_special_tokens else ()
        return b" ".join([self.tokens[i] for i in ids if i not in drop]).decode()


_MARKS = frozenset(".,;:!?")
#: Code points that str.split() takes for white space and the patterns' \s does not.
_ODD = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"\s+")


def _split_exact(text: str) -> list[str]:
    return [x for x in _SPACES.split(text) if x]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every whole text: its token ids and what they decode to. The
    file at ``tokenizer_path`` is read by the driver and sent along (a few MB)."""
    return _mapped(docs, tokenizer_path, id_col, text_col, "id bigint, ids array<int>, decoded string", lambda enc, ids, found: {"id": ids, "ids": found, "decoded": [enc.decode(x.tolist()) for x in found]})


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as :func:`encode_documents`, but only the
    digests of the ids (decimal, joined by spaces) and of the decoded text leave the worker."""
    import hashlib

    def digest(enc, ids, found):
        out = {"id": ids, "n_tokens": [len(x) for x in found], "ids_sha256": [], "decoded_sha256": []}
        for x in found:
            x = x.tolist()
            out["ids_sha256"].append(hashlib.sha256(b" ".join(map(enc.decimals.__getitem__, x))).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode(x).encode()).hexdigest())
        return out

    return _mapped(docs, tokenizer_path, id_col, text_col, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def encoder_for(spec: str) -> Encoder:
    """The encoder of this worker, shared by all its tasks."""
    return kept(("bpe", spec), lambda: Encoder(spec))


def _mapped(docs, tokenizer_path, id_col, text_col, schema, finish):
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(ids, texts):
        encoder = encoder_for(spec.value)
        return finish(encoder, ids, encoder.encode_batch(texts))

    return map_texts(docs, id_col, text_col, schema, run, max_bytes=2 << 20)

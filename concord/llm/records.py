"""Token-ID output: length-delimited binary records with an offset index.

A file is a run of frames: an unsigned 64-bit length, its masked CRC-32C, the serialized
sequence, and the masked CRC-32C of that (all little-endian). A sequence is its id (int64),
the width of an element (1 byte: 2 or 4) and the token ids. The index, a Parquet table,
holds the byte range of every frame, so single records can be read in any order.

Each task writes files of its own name and reports them in the rows it returns; the index
lists the files of tasks that succeeded, so what a lost or repeated attempt leaves behind
is never read. Files go to the shared folder through ``pyarrow.fs``.

Null texts are empty: only the end id. Rows are written in ascending id, null ids first,
and rows of one id by their text. An empty table writes no file and an empty index. Very long
texts are one record each; other columns, whatever their names, are left out first.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from concord.llm._common import kept, materialize, shared_path, slices
from concord.llm.bpe import byte_alphabet

HEAD = struct.Struct("<QI")
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
MASK_DELTA = 0xA282EAD8
BLOCK = 64
#: Fixed value: the pattern that byte-level BPE of this kind cuts texts with.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---------------------------------------------------------------- CRC-32C


@cache
def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map, given by the images of the 32 bits, on many values."""
    out = np.zeros(values.shape, np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@cache
def _advance(zeros_log2: int) -> np.ndarray:
    """The map that appends 2**zeros_log2 zero bytes to a raw CRC."""
    if zeros_log2 == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return (bits >> np.uint32(8)) ^ _byte_table()[bits & np.uint32(255)]
    half = _advance(zeros_log2 - 1)
    return _apply(half, half)


@cache
def _block_tables() -> np.ndarray:
    """tables[k][byte]: what a byte at place k of a block adds to the block's raw CRC."""
    tables = [_byte_table()]
    for _ in range(BLOCK - 1):
        last = tables[-1]
        tables.append((last >> np.uint32(8)) ^ _byte_table()[last & np.uint32(255)])
    return np.stack(tables[::-1])


@cache
def _level_tables(level: int) -> np.ndarray:
    """tables[k][j][byte]: a raw CRC's byte j at place k of 64 blocks of 64**level bytes,
    moved to the end."""
    one, columns, out = _advance(6 * level), np.uint32(1) << np.arange(32, dtype=np.uint32), []
    values = np.arange(256, dtype=np.uint32)
    for _ in range(BLOCK):
        out.append(np.stack([_apply(columns, values << np.uint32(8 * j)) for j in range(4)]))
        columns = _apply(one, columns)
    return np.stack(out[::-1])


def _padded(values: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Runs of ``values`` moved to the ends of ``groups`` times 64 places, zeros in front."""
    out = np.zeros(int(groups.sum()) * BLOCK, values.dtype)
    begin = np.cumsum(groups) * BLOCK - lengths
    shift = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    out[np.arange(len(values)) + shift] = values
    return out.reshape(-1, BLOCK)


def crc32c_many(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32C of consecutive runs of ``data`` (bytes), ``lengths`` bytes each."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if not len(lengths):
        return np.zeros(0, np.uint32)
    count = np.maximum(1, -(-lengths // BLOCK))
    matrix, tables = _padded(np.asarray(data, dtype=np.uint8), lengths, count), _block_tables()
    raw = np.zeros(len(matrix), np.uint32)
    for k in range(BLOCK):
        raw ^= tables[k][matrix[:, k]]
    level = 1
    while count.max() > 1:
        groups = -(-count // BLOCK)
        matrix, tables = _padded(raw, count, groups), _level_tables(level)
        raw = np.zeros(len(matrix), np.uint32)
        for k in range(BLOCK):
            for j in range(4):
                raw ^= tables[k][j][matrix[:, k] >> np.uint32(8 * j) & np.uint32(255)]
        count, level = groups, level + 1
    start = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for bit in range(int(lengths.max()).bit_length()):
        moved = lengths >> bit & 1 == 1
        if moved.any():
            start[moved] = _apply(_advance(bit), start[moved])
    return raw ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted by a constant, so that a CRC over data with CRCs stays sound."""
    crc = np.asarray(crc, dtype=np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


# ---------------------------------------------------------------- frames


def frames(bodies: list[bytes]) -> list[bytes]:
    """Each body framed."""
    if not bodies:
        return []
    sizes = np.fromiter(map(len, bodies), np.uint64, len(bodies))
    heads = masked(crc32c_many(np.frombuffer(sizes.astype("<u8").tobytes(), np.uint8), np.full(len(bodies), 8)))
    tails = masked(crc32c_many(np.frombuffer(b"".join(bodies), np.uint8), sizes.astype(np.int64)))
    return [HEAD.pack(n, h) + body + struct.pack("<I", t) for n, h, body, t in zip(sizes.tolist(), heads.tolist(), bodies, tails.tolist())]


def unframe(data: bytes) -> list[bytes]:
    """The bodies of whole frames; ``ValueError`` on a wrong length or checksum."""
    bodies, claims, at = [], [], 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError("a frame is cut short")
        size, head = HEAD.unpack_from(data, at)
        at += HEAD.size
        if at + size + 4 > len(data):
            raise ValueError("a frame is cut short")
        bodies.append(data[at : at + size])
        claims.append((size, head, struct.unpack_from("<I", data, at + size)[0]))
        at += size + 4
    if bodies:
        sizes, heads, tails = (np.array(x, dtype=np.uint64) for x in zip(*claims))
        if (masked(crc32c_many(np.frombuffer(sizes.astype("<u8").tobytes(), np.uint8), np.full(len(bodies), 8))) != heads.astype(np.uint32)).any():
            raise ValueError("a length fails its checksum")
        if (masked(crc32c_many(np.frombuffer(b"".join(bodies), np.uint8), sizes.astype(np.int64))) != tails.astype(np.uint32)).any():
            raise ValueError("a record fails its checksum")
    return bodies


_SEQ = struct.Struct("<?qB")


def serialize(identifier: int | None, ids: np.ndarray, width: int) -> bytes:
    return _SEQ.pack(identifier is not None, identifier or 0, width) + ids.astype(f"<u{width}").tobytes()


def deserialize(body: bytes) -> tuple[int | None, np.ndarray]:
    has, identifier, width = _SEQ.unpack_from(body)
    return (identifier if has else None), np.frombuffer(body, dtype=f"<u{width}", offset=_SEQ.size)


# ---------------------------------------------------------------- tokens


class LibraryEncoder:
    """The tokenizers library behind caches. A byte-level pattern ends a piece before every
    single space that a letter follows, so texts are cut there, and the chunks into the
    pattern's pieces; pieces that are not known yet go to the library, many at once. A text
    with a space before other white space, or with a special token, goes to it whole."""

    def __init__(self, spec: str, limit: int = 800_000):
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        read = json.loads(spec)
        pre = read.get("pre_tokenizer") or {}
        self.usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not read.get("normalizer")
        self.pattern = regex.compile(PIECES)
        self.alphabet = byte_alphabet()
        self.chunks: dict[str, bytes | None] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> list[bytes]:
        """Words, each with or without a space in front, that are one piece each: the
        library's model merges their bytes, written in its alphabet."""
        tokenize, alphabet = self.tokenizer.model.tokenize, self.alphabet
        return [array("I", [t.id for t in tokenize(w.encode().decode("latin-1").translate(alphabet))]).tobytes() for w in words]

    def _learn(self, fresh: set[str]) -> None:
        """Put what ``fresh`` chunks encode to into the cache, and their pieces too."""
        known, words, marked, mixed = self.chunks, [], [], []
        for chunk in fresh:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                words.append(chunk)
            elif chunk[-1] in ".,;:!?" and word[:-1].isalpha():
                marked.append(chunk)
            elif chunk[0] == " " and (not word or word[0].isspace()):
                known[chunk] = None  # only the whole text can settle it
            else:
                mixed.append((chunk, self.pattern.findall(chunk)))
        pieces = {c[:-1] for c in marked}.union(c[-1] for c in marked).union(*(p for _, p in mixed)).difference(known, fresh)
        other = [p for p in pieces.union(c for c, p in mixed if len(p) == 1) if not (p[1:] if p[0] == " " else p).isalpha()]
        words += pieces.difference(other)
        known.update(zip(words, self._words(words)))
        known.update(zip(other, self._whole(other)))
        for chunk in marked:
            known[chunk] = known[chunk[:-1]] + known[chunk[-1]]
        for chunk, parts in mixed:
            if len(parts) != 1:
                known[chunk] = b"".join([known[p] for p in parts])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, four bytes each."""
        if not self.usual:
            return self._whole([t or "" for t in texts])
        out: list = [None] * len(texts)
        whole, split = [], []
        for n, text in enumerate(texts):
            if not text:
                out[n] = b""
            elif "\0" in text or any(x in text for x in self.special):
                whole.append(n)
            else:
                split.append((n, text.replace(" ", "\0 ").split("\0")))
        fresh = set().union(*(c for _, c in split)).difference(self.chunks)
        if len(self.chunks) + len(fresh) > self.limit:
            self.chunks.clear()
            fresh = set().union(*(c for _, c in split))
        fresh.discard("")
        self.chunks[""] = b""
        self._learn(fresh)
        get = self.chunks.__getitem__
        for n, chunks in split:
            try:
                out[n] = b"".join(map(get, chunks))
            except TypeError:  # a chunk that only the whole text can settle
                whole.append(n)
        for n, ids in zip(whole, self._whole([texts[n] for n in whole])):
            out[n] = ids
        return out


def encoder_for(spec: str) -> LibraryEncoder:
    """The encoder of this worker, shared by all its tasks."""
    return kept(("records", spec), lambda: LibraryEncoder(spec))


INDEX = "id bigint, part int, seq bigint, file string, offset bigint, length bigint, n_tokens bigint, start_in_part bigint"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", max_file_bytes: int = 256 << 20) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the records in ascending id.
    Returns the offset index, itself written to the shared folder: (id, part, seq, file,
    offset, length, n_tokens, start), ``start`` being the number of ids before the record."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # bounded: a tokenizer's file
    folder = shared_path(spark, "records")
    arrow = to_arrow_schema(_parse_datatype_string(INDEX))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        encoder = encoder_for(spec.value)
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], dtype="<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, run = TaskContext.get().partitionId(), uuid.uuid4().hex
        out = None
        rolled = seq = start = offset = 0
        name = ""
        try:
            for batch in batches:
                for piece in slices(batch, 1, 8 << 20):
                    ids = piece.column(0).to_pylist()
                    tokens = [np.frombuffer(x + end, dtype="<u4") for x in encoder.encode_batch(piece.column(1).to_pylist())]
                    rows = []
                    for i, x, frame in zip(ids, tokens, frames([serialize(i, x, width) for i, x in zip(ids, tokens)])):
                        if out is None or offset and offset + len(frame) > max_file_bytes:
                            if out is not None:
                                out.close()
                            name = f"part-{part:06d}-{rolled:04d}-{run}.rec"
                            out, rolled, offset = store.open_output_stream(f"{base}/{name}"), rolled + 1, 0
                        out.write(frame)
                        rows.append((i, part, seq, name, offset, len(frame), len(x), start))
                        seq, offset, start = seq + 1, offset + len(frame), start + len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        finally:
            if out is not None:
                out.close()

    dealt = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    index = materialize(dealt.mapInArrow(write, INDEX), "record-index")
    ahead = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    index = index.join(ahead, "part")  # one row for each task
    return index.select("id", "part", "seq", F.concat(F.lit(f"{folder}/"), "file").alias("file"), "offset", "length", "n_tokens", (F.col("ahead") + F.col("start_in_part")).alias("start"))


def read_records(index: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """(id, start, ids): the records that the rows of an index point to, checked. Rows of
    one file are read in order, neighbours at once; any selection of rows can be read."""
    return _read(index, "id bigint, start bigint, ids array<int>", lambda i, start, ids: (i, start, ids.astype(np.int32)), batch_bytes)


def read_digests(index: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): as :func:`read_records`, with the CRC-32 of the ids
    as little-endian unsigned 32-bit integers in their place."""
    return _read(index, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", lambda i, start, ids: (i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), batch_bytes)


def _read(index: DataFrame, schema: str, finish, batch_bytes: int) -> DataFrame:
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def flush(source, run):
        first, last = run[0][1], run[-1][1] + run[-1][2]
        bodies = unframe(source.read_at(last - first, first))
        rows = [finish(deserialize(body)[0], start, deserialize(body)[1]) for body, (_, _, _, start) in zip(bodies, run, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def read(batches):
        source, opened, run = None, None, []
        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    if run and (row[0] != run[-1][0] or row[1] != run[-1][1] + run[-1][2] or row[1] + row[2] - run[0][1] > batch_bytes):
                        yield flush(source, run)
                        run = []
                    if row[0] != opened:
                        if source is not None:
                            source.close()
                        store, path = fs.FileSystem.from_uri(row[0])
                        source, opened = store.open_input_file(path), row[0]
                    run.append(row)
            if run:
                yield flush(source, run)
        finally:
            if source is not None:
                source.close()

    return index.select("file", "offset", "length", "start").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(read, schema)

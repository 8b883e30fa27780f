"""Matroska, binary records and WARC archives: exact round trips and brute force."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from concord.llm import matroska, queries, records, warc

TEXTS = [(1, "plain text"), (2, None), (3, ""), (None, "no id"), (4, "é" * 96), (5, "plain text"), (5, "plain text"), (6, "long " * 40_000), (7, "\0\r\n\r\nWARC/1.1\r\n<|endoftext|>  \n \n x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in TEXTS], "doc_id bigint, text string, id string, media int")


def test_lacing_round_trip():
    rnd = random.Random(3)
    for kind in (0, 1, 2, 3):
        for _ in range(60):
            count = 1 if kind == 0 else rnd.randint(1, 12)
            sizes = [rnd.choice([0, 1, 254, 255, 256, 600, 20_000]) for _ in range(count)]
            if kind == 2:
                sizes = [rnd.randint(0, 900)] * count
            frames = [rnd.randbytes(n) for n in sizes]
            body = matroska.block(3, -7, 0x80 | kind << 1, matroska.lace(frames, kind))
            track, relative, flags, ranges = matroska.frames_of(body, 0, len(body))
            assert (track, relative, flags >> 1 & 3) == (3, -7, kind)
            assert [body[a : a + n] for a, n in ranges] == frames


def test_block_groups_unknown_sizes_and_damage():
    el = matroska.element
    head = el(matroska.EBML, el(matroska.DOC_TYPE, b"matroska"))
    track = el(matroska.TRACK_ENTRY, el(matroska.TRACK_NUMBER, b"\2") + el(matroska.TRACK_TYPE, b"\1") + el(matroska.CODEC_ID, b"V_X"))
    group = el(matroska.BLOCK_GROUP, el(matroska.BLOCK, matroska.block(2, 5, 0, b"abc")) + el(matroska.BLOCK_DURATION, b"\x28") + el(matroska.REFERENCE_BLOCK, b"\1"))
    unknown = matroska._id(matroska.CLUSTER) + b"\xff" + el(matroska.CLUSTER_TIMESTAMP, b"\x64") + group
    segment = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + el(matroska.TRACKS, track) + unknown + unknown
    found = matroska.demux(head + segment)
    assert [(p[0], p[1], p[2], p[3]) for p in found.packets] == [(2, 105_000_000, 40_000_000, False)] * 2
    assert len(found.clusters) == 2 and matroska.payload_of(head + segment, found, 2) == b"abcabc"
    whole = matroska.mux_pcm(bytes(192))
    for bad in (b"", b"junk", whole[:-3], whole[:40]):
        with pytest.raises(ValueError):
            matroska.demux(bad)


def test_media_columns(spark, docs):
    stored = matroska.store_texts(docs)
    rows = matroska.media_features(stored).collect()
    assert len(rows) == len(TEXTS)
    want = {}
    for i, t in TEXTS:
        data = (t or "").encode()
        want.setdefault(i, []).append(data + b" " * ((192 - len(data) % 192) % 192 if data else 192))
    for r in rows:
        payload = want[r.id][0]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.n_bytes == len((dict(TEXTS)[r.id] or "").encode()) and r.n_packets == len(payload) // 192 and r.error is None
    same = {r.media_sha256 + r.feature for r in rows if r.id in (1, 5)}
    assert len(same) == 1
    packets = matroska.packet_table(stored, "id", "media").where("id = 6").orderBy("packet").collect()
    assert [p.timestamp_ns for p in packets[:9]] == [n * 24_000_000 for n in range(9)] and len(packets) == len(want[6][0]) // 192
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "id bigint, media binary")
    assert [(r.error is None, r.payload_bytes) for r in matroska.media_features(odd).orderBy("id").collect()] == [(True, None), (False, None)]
    assert matroska.media_features(matroska.store_texts(docs.limit(0))).count() == 0


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c():
    assert slow_crc32c(b"123456789") == 0xE3069283
    rnd = random.Random(5)
    parts = [rnd.randbytes(n) for n in (0, 1, 8, 63, 64, 65, 128, 4095, 4096, 4097, 9000)] + [b""]
    got = records.crc32c_many(np.frombuffer(b"".join(parts), np.uint8), [len(p) for p in parts])
    assert got.tolist() == [slow_crc32c(p) for p in parts]


def test_frames_notice_damage():
    bodies = [b"", b"abc", bytes(1000)]
    data = b"".join(records.frames(bodies))
    assert records.unframe(data) == bodies
    assert struct.unpack_from("<Q", data)[0] == 0
    for at in (0, 9, 13, 20, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))


def test_chunked_library_encoder():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), records.LibraryEncoder(open(path, encoding="utf-8").read(), limit=500)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab é's '\n\t  \0,.12<|>中\x1c\x85　") for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>b", None, " a", "a ", "  ", "\n a"]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 100) for x in own.encode_batch(texts[at : at + 100])]
    assert got == want


def test_token_records(spark, docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    index = records.write_tokens(docs, path, max_file_bytes=300).cache()
    assert index.select("file").distinct().count() > 2
    start = 0
    want = []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, records.read_digests(index).collect()), key=lambda r: r[1])
    assert got == want
    some = records.read_records(index.where("id in (7, 1)")).collect()
    assert {r.id: len(r.ids) for r in some} == {r[0]: r[2] for r in want if r[0] in (1, 7)}
    assert records.read_digests(records.write_tokens(docs.limit(0), path)).count() == 0


PAGES = [(1, "http://a", "same"), (9, "http://b\r\nX: y", "same"), (5, None, "same"), (2, "u", None), (3, "u", ""), (4, "u", "WARC/1.1\r\n\r\n" * 9), (7, "u", "é"), (7, "u", "é"), (None, "u", "alone")]


def test_archive(spark):
    pages = spark.createDataFrame([(*p, "x", b"y") for p in PAGES], "page_id bigint, url string, html string, address string, header binary")
    for least in (0, 3, 100):
        archive = warc.write_archive(pages, min_bytes=least)
        assert archive.payloads.count() == len({(p[2] or "") for p in PAGES})
        rows = warc.read_digests(archive).collect()
        assert len(rows) == len(PAGES)
        for r in rows:
            data = next((p[2] or "").encode() for p in PAGES if p[0] == r.id)
            group = [p[0] for p in PAGES if (p[2] or "").encode() == data and p[0] is not None]
            top = max(group) if group and len(data) >= least else None
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            revisit = top is not None and r.id != top
            assert (r.record_type, r.refers_to) == (("revisit", top) if revisit else ("response", None))
    full = warc.read_records(warc.write_archive(pages)).collect()
    file = b"".join(bytes(r.record) for r in full)
    assert [bytes(h) for h, _ in warc.parse(file)] == [bytes(r.header) for r in full]
    assert all(block == (b"" if r.record_type == "revisit" else bytes(r.payload)) for (_, block), r in zip(warc.parse(file), full))
    assert sum("x: y" in warc.fields_of(bytes(r.header)).get("warc-target-uri", "").lower() for r in full) == 1
    assert warc.read_digests(warc.write_archive(pages.limit(0))).count() == 0


def test_damaged_archive(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id bigint, url string, html string"))
    broken = warc.Archive(archive.records, archive.payloads.selectExpr("address", "unhex('28b52ffd2003190000616264') packed"))
    with pytest.raises(Exception, match="does not match|decompress|zstd"):
        warc.read_digests(broken).collect()


def test_damaged_media(spark):
    """Whatever the bytes, demux reads them or raises ValueError, and no job fails."""
    rnd = random.Random(4)
    whole = matroska.mux_pcm(bytes(rnd.randrange(256) for _ in range(192 * 30)), {"SOURCE_BYTES": "17"})
    values = [b"", b"\x1a", whole[:40], whole + whole, b"\x1a\x45\xdf\xa3\xff" * 3000, whole.replace(b"\xd7\x81\x01", b"\xd7\x81\x02")]
    for _ in range(700):
        data = bytearray(whole)
        for _ in range(rnd.randint(1, 12)):
            kind, at = rnd.randrange(3), rnd.randrange(min(len(data), 300)) if rnd.random() < 0.7 else rnd.randrange(len(data))
            if kind == 0:
                data[at] = rnd.choice([0, 1, 0x7F, 0x80, 0xFE, 0xFF, rnd.randrange(256)])
            elif kind == 1:
                del data[at : at + rnd.randint(1, 9)]
            else:
                data[at:at] = bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 9)))
        values.append(bytes(data))
    for data in values:
        try:
            matroska.demux(data)
        except ValueError:
            pass
    frame = spark.createDataFrame([(n, bytearray(d), 1) for n, d in enumerate(values)], "id bigint, media binary, packet int")
    assert matroska.packet_table(frame, "id", "media").count() > 0
    assert matroska.media_features(frame).count() == len(values)


def test_media_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "é" * 300_000, "y"), (2, "é" * 300_000, "y")], "doc_id bigint, text string, media string")
    got = matroska.media_features(matroska.store_texts(docs)).collect()
    assert sorted(r.n_bytes for r in got) == [0, 0, 600_000, 600_000] and len({r.media_sha256 for r in got}) == 2
    assert matroska.media_features(matroska.store_texts(docs.limit(0))).count() == 0

"""Media columns: a Matroska muxer and demuxer over binary columns.

``demux`` parses variable-length EBML elements, clusters, blocks in every lacing
and cues into packet tables with timestamps, tracks and byte ranges. ``mux_pcm``
writes 8-bit samples losslessly, so any byte string can be carried as audio.

Null media: no packets and null fields. Bytes that are no Matroska file, or a damaged one,
raise ``ValueError`` in :func:`demux`, nothing else, and give an ``error`` text in the
columns. Very long texts are stored and read whole; repeated rows are stored again; an empty
table gives empty results; other columns, whatever their names, are left out first.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm._common import map_texts, materialize, slices

# Element identifiers of the Matroska specification (RFC 9559).
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1254C367
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TAG, SIMPLE_TAG, TAG_NAME, TAG_STRING = 0x7373, 0x67C8, 0x45A3, 0x4487
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, 0x1043A770, 0x1941A469}

FRAME = 192  # bytes of a frame: 24 ms of 8-bit samples at 8 kHz
RATE = 8000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 128


@dataclass
class Media:
    """What :func:`demux` found. ``packets``: (track, timestamp in ns, duration in ns
    or None, keyframe, byte offset, size). ``cues``: (time in ns, track, byte offset
    of the cluster)."""

    doc_type: str = ""
    timestamp_scale: int = 1_000_000
    duration_ns: int | None = None
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)


# ---------------------------------------------------------------- writing


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """A data size: the leading one bit tells the width; all-ones is kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << (7 * w)) - 1)
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(identifier: int, body: bytes) -> bytes:
    return _id(identifier) + vint(len(body)) + body


def _uint(identifier: int, value: int) -> bytes:
    return element(identifier, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames of one block behind each other: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 2:
        if len(set(sizes)) > 1:
            raise ValueError("fixed-size lacing needs equal frames")
    elif sizes[:-1]:
        head += vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(now - before) < (1 << (7 * w - 1)) - 1)
            head += vint(now - before + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def block(track: int, relative: int, flags: int, body: bytes) -> bytes:
    return vint(track) + struct.pack(">hB", relative, flags) + body


def mux_pcm(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """``payload`` (a positive multiple of 192 bytes) as unsigned 8-bit mono samples at
    8 kHz in a Matroska file. The same payload and tags give the same bytes."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    per_block, ms = FRAMES_PER_BLOCK * FRAME, 1000 * FRAME // RATE
    head = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"concord") + element(WRITING_APP, b"concord"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, zlib.crc32(payload) + 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, ms * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    named = b"".join(element(SIMPLE_TAG, element(TAG_NAME, k.encode()) + element(TAG_STRING, v.encode())) for k, v in sorted((tags or {}).items()))
    parts = [info, tracks] + ([element(TAGS, element(TAG, named))] if named else [])
    position, cues = sum(map(len, parts)), []
    for at in range(0, len(payload), BLOCKS_PER_CLUSTER * per_block):
        start = at // FRAME * ms
        blocks = []
        for b in range(at, min(at + BLOCKS_PER_CLUSTER * per_block, len(payload)), per_block):
            body = payload[b : b + per_block]
            fixed = len(body) > FRAME
            blocks.append(element(SIMPLE_BLOCK, block(1, b // FRAME * ms - start, 0x84 if fixed else 0x80, (bytes([len(body) // FRAME - 1]) if fixed else b"") + body)))
        cluster = element(CLUSTER, _uint(CLUSTER_TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, position))))
        parts.append(cluster)
        position += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- reading


def _read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"bad element identifier at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def _read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """The value and the byte after it; None where the size is unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"bad size at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("the file ends within a size")
    value = int.from_bytes(data[at : at + width], "big") & (1 << (7 * width)) - 1
    return (None if value == (1 << (7 * width)) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, stop: set[int] = frozenset(), depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, start, first byte of the body, end) of the elements from ``at``;
    one of unknown size reaches to the next element in ``stop`` or to ``end``. Elements of
    unknown size nest no deeper than a segment and its clusters."""
    if depth > 3:
        raise ValueError(f"elements of unknown size nest too deep at byte {at}")
    while at < end:
        identifier, after = _read_id(data, at)
        if identifier in stop:
            return
        size, body = _read_size(data, after)
        if size is None:
            last = body
            inner = TOP_LEVEL if identifier == CLUSTER else set()
            for _, _, _, last in elements(data, body, end, inner, depth + 1):
                pass
        else:
            last = body + size
        if last > end:
            raise ValueError(f"the element at byte {at} reaches beyond its parent")
        yield identifier, at, body, last
        at = last


def _number(data: bytes, body: int, end: int) -> int:
    if end - body > 8:
        raise ValueError(f"the number at byte {body} is too long")
    return int.from_bytes(data[body:end], "big")


def _float(data: bytes, body: int, end: int) -> float:
    if end - body not in (0, 4, 8):
        raise ValueError(f"the number at byte {body} has no usual length")
    value = struct.unpack(">d" if end - body == 8 else ">f", data[body:end])[0] if end > body else 0.0
    if not math.isfinite(value):
        raise ValueError(f"the number at byte {body} is not finite")
    return value


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and byte ranges (offset, size) of a block's frames."""
    track, at = _read_size(data, at)
    if track is None or track >= 1 << 31 or at + 3 > end:
        raise ValueError(f"the block at byte {at} is cut short or names no track")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == 0:
        return track, relative, flags, [(at, end - at)]
    if at >= end:
        raise ValueError(f"the lacing at byte {at} is cut short")
    count, at = data[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError("a block of fixed-size lacing does not divide evenly")
        return track, relative, flags, [(at + i * size, size) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if at >= end:
            raise ValueError(f"the lacing at byte {at} is cut short")
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
                if at >= end:
                    raise ValueError(f"the lacing at byte {at} is cut short")
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length()
            size, at = _read_size(data, at)
            if size is None:
                size = (1 << (7 * width)) - 1
            if i:
                size = sizes[-1] + size - ((1 << (7 * width - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes reach beyond their block")
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    return track, relative, flags, ranges


def _track(data: bytes, body: int, end: int) -> dict:
    out = {"number": 0, "type": 0, "codec": "", "default_duration_ns": None, "rate": None, "channels": None, "bits": None}
    for i, _, b, e in elements(data, body, end):
        if i == TRACK_NUMBER:
            out["number"] = _number(data, b, e)
        elif i == TRACK_TYPE:
            out["type"] = _number(data, b, e)
        elif i == CODEC_ID:
            out["codec"] = data[b:e].decode()
        elif i == DEFAULT_DURATION:
            out["default_duration_ns"] = _number(data, b, e)
        elif i == AUDIO:
            for j, _, c, d in elements(data, b, e):
                if j == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, c, d)
                elif j == CHANNELS:
                    out["channels"] = _number(data, c, d)
                elif j == BIT_DEPTH:
                    out["bits"] = _number(data, c, d)
    return out


def demux(data: bytes) -> Media:
    """Parse a whole Matroska file; ``ValueError`` if it is none or is cut short."""
    out, seen, raw_duration = Media(), False, None
    top = iter(elements(data, 0, len(data)))
    identifier, _, body, end = next(top, (0, 0, 0, 0))
    if identifier != EBML:
        raise ValueError("no EBML header")
    for i, _, b, e in elements(data, body, end):
        if i == DOC_TYPE:
            out.doc_type = data[b:e].decode()
    durations: dict[int, int | None] = {}
    for identifier, _, base, end in top:
        if identifier != SEGMENT:
            continue
        seen = True
        for i, start, b, e in elements(data, base, end):
            if i == INFO:
                for j, _, c, d in elements(data, b, e):
                    if j == TIMESTAMP_SCALE:
                        out.timestamp_scale = _number(data, c, d)
                    elif j == DURATION:
                        raw_duration = _float(data, c, d)
            elif i == TRACKS:
                out.tracks += [_track(data, c, d) for j, _, c, d in elements(data, b, e) if j == TRACK_ENTRY]
                durations = {t["number"]: t["default_duration_ns"] for t in out.tracks}
            elif i == CLUSTER:
                out.clusters.append(start)
                time = 0
                for j, _, c, d in elements(data, b, e, TOP_LEVEL):
                    if j == CLUSTER_TIMESTAMP:
                        time = _number(data, c, d)
                    elif j == SIMPLE_BLOCK:
                        _add(out, durations, time, *frames_of(data, c, d), None, None)
                    elif j == BLOCK_GROUP:
                        group = {k: (x, y) for k, _, x, y in elements(data, c, d)}
                        if BLOCK in group:
                            _add(out, durations, time, *frames_of(data, *group[BLOCK]), _number(data, *group[BLOCK_DURATION]) if BLOCK_DURATION in group else None, REFERENCE_BLOCK not in group)
            elif i == CUES:
                for j, _, c, d in elements(data, b, e):
                    cue = {k: (x, y) for k, _, x, y in elements(data, c, d)}
                    if j == CUE_POINT and CUE_TRACK_POSITIONS in cue and CUE_TIME in cue:
                        where = {k: _number(data, x, y) for k, _, x, y in elements(data, *cue[CUE_TRACK_POSITIONS])}
                        out.cues.append((_number(data, *cue[CUE_TIME]) * out.timestamp_scale, where.get(CUE_TRACK, 0), base + where.get(CUE_CLUSTER_POSITION, 0)))
            elif i == TAGS:
                for j, _, c, d in elements(data, b, e):
                    for k, _, x, y in elements(data, c, d) if j == TAG else ():
                        if k == SIMPLE_TAG:
                            pair = {m: data[p:q].decode() for m, _, p, q in elements(data, x, y)}
                            out.tags[pair.get(TAG_NAME, "")] = pair.get(TAG_STRING, "")
    if not seen:
        raise ValueError("no segment")
    out.duration_ns = None if raw_duration is None else round(raw_duration * out.timestamp_scale)
    times = [abs(v) for p in out.packets for v in (p[1], p[2] or 0)] + [v for c in out.cues for v in c] + [abs(out.duration_ns or 0)]
    if max(times) >= 1 << 63:
        raise ValueError("a time is out of range")
    return out


def _add(out: Media, durations: dict, time: int, track: int, relative: int, flags: int, ranges: list, span: int | None, key: bool | None) -> None:
    at, each = (time + relative) * out.timestamp_scale, durations.get(track)
    if span is not None and not each:
        each = span * out.timestamp_scale // len(ranges)
    key = bool(flags & 0x80) if key is None else key
    for n, (offset, size) in enumerate(ranges):
        out.packets.append((track, at + n * (each or 0), each, key, offset, size))


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of one track behind each other."""
    return b"".join([data[p[4] : p[4] + p[5]] for p in media.packets if p[0] == track])


# ---------------------------------------------------------------- columns

PACKETS = "id bigint, packet int, track int, timestamp_ns bigint, duration_ns bigint, keyframe boolean, byte_offset bigint, byte_size bigint"


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet of each media value; rows with null or unreadable media
    have none. Repeated rows repeat their packets."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(PACKETS))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for i, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    try:
                        packets = demux(data).packets if data is not None else []
                    except ValueError:
                        packets = []
                    rows += [(i, n, *p) for n, p in enumerate(packets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(arrow), arrow)], schema=arrow)

    return df.select(F.col(id_col).cast("bigint"), F.col(media_col)).mapInArrow(run, PACKETS)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text (null: empty) as UTF-8, spaces appended up to a positive
    multiple of 192, muxed as 8-bit samples and written to the shared folder. Any id type
    that casts to bigint is kept, null ids too; repeated rows are stored again."""

    def pack(ids, texts):
        media = []
        for text in texts:
            data = (text or "").encode()
            media.append(mux_pcm(data + b" " * (-len(data) % FRAME or (0 if data else FRAME)), {"SOURCE_BYTES": str(len(data))}))
        return {"id": ids, "media": media}

    return materialize(map_texts(docs, id_col, text_col, "id bigint, media binary", pack), "media")


FEATURES = "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint, n_clusters int, n_cues int, duration_ns bigint, error string"


def media_features(stored: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Read media values back and describe them; null media gives null fields, unreadable
    media an ``error`` and null fields."""

    def describe(ids, values):
        out = {name.split()[0]: [] for name in FEATURES.split(", ")}
        for i, data in zip(ids, values):
            row = dict.fromkeys(out) | {"id": i}
            if data is not None:
                try:
                    media = demux(data)
                    if not media.tracks or not media.packets:
                        raise ValueError("no track, or no packets")
                    track = media.tracks[0]
                    payload = payload_of(data, media, track["number"])
                    if not payload or track["rate"] is None:
                        raise ValueError("the first track holds no samples")
                    cued = {at for _, _, at in media.cues} == set(media.clusters)
                    row |= {"n_bytes": int(media.tags.get("SOURCE_BYTES", len(payload))), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "n_packets": len(media.packets), "n_clusters": len(media.clusters), "n_cues": len(media.cues), "duration_ns": media.duration_ns}
                    row["feature"] = f"{media.doc_type};{track['codec']};rate={track['rate']:.0f};bits={track['bits'] or 0};packets={len(media.packets)};clusters={len(media.clusters)};cued={str(cued).lower()};last_ns={media.packets[-1][1]};mean={sum(payload) / len(payload):.6f}"
                except ValueError as e:
                    row["error"] = str(e)
            for name, values_ in out.items():
                values_.append(row[name])
        return out

    return map_texts(stored, id_col, media_col, FEATURES, describe)

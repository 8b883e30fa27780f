"""WARC archives, content-addressed.

An archive is two tables in the shared folder. ``payloads`` holds each distinct payload
once, compressed, under its SHA-256; ``records`` holds the exact header bytes of every
record and the address of its payload. Joining the two on the address gives the original
records back, byte for byte; each payload is verified against its address and against the
SHA-1 in the header as it is read.

Rows with a null payload have the empty one. A null id is written as ``null`` and stays
null. Of rows with equal payloads of at least ``min_bytes`` the one with the largest id is
the response and the others revisit it; rows that repeat its id are responses too. An
empty table gives an empty archive. Very long payloads are kept whole; other columns, whatever
their names, are left out first.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm._common import materialize, slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """``records``: id, header (binary), address. ``payloads``: address, packed (binary)."""

    records: DataFrame
    payloads: DataFrame


def base32(hex_sha1):
    """The Base32 form of a column of 40 hexadecimal digits: each five make four letters."""
    parts = [F.lpad(F.conv(F.substring(hex_sha1, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(column):
    return F.concat(F.lit("<urn:concord:record:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write one record for each row; see the module for what becomes a revisit."""
    source = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    def pack(batches):
        seen, packer = set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, 0):
                rows = []
                for data in part.column(0).to_pylist():
                    address = hashlib.sha256(data).digest()
                    if address not in seen:  # copies leave a task once
                        seen.add(address)
                        rows.append((address, packer.compress(data)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.binary()) for n in (0, 1)], names=["address", "packed"])

    def once(batches):
        last = None
        for batch in batches:
            address = batch.column(0).to_pylist()
            keep = [a != b for a, b in zip(address, [last, *address])]
            last = address[-1] if address else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    shape = "address binary, packed binary"
    payloads = materialize(source.select("payload").mapInArrow(pack, shape).repartition("address").sortWithinPartitions("address").mapInArrow(once, shape), "warc-payloads", "none")
    light = source.select("id", "url", F.unhex(F.sha2("payload", 256)).alias("address"), base32(F.sha1("payload")).alias("sha1"), F.length("payload").alias("size"))
    chosen = light.where(F.col("size") >= min_bytes).groupBy("address").agg(F.max("id").alias("chosen"))
    joined = light.join(chosen, "address", "left")
    revisit = F.col("chosen").isNotNull() & ~F.col("id").eqNullSafe(F.col("chosen"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _urn(F.col("chosen")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("size").cast("string")),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    return Archive(materialize(joined.select("id", header.alias("header"), "address"), "warc-records"), payloads)


def fields_of(header: bytes) -> dict[str, str]:
    """Header fields by lower-case name; ``ValueError`` if it is no WARC header."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header with its blank line, block) of each record of a plain WARC file, or of one
    compressed record by record; ``ValueError`` where it is cut short."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            unpacker = zlib.decompressobj(31)
            plain.append(unpacker.decompress(data) + unpacker.flush())
            data = unpacker.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a header is cut short")
        header = data[at : end + 4]
        size = int(fields_of(header)["content-length"])
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a block is cut short")
        yield header, data[end + 4 : at]
        at += 4


def _verified(address: bytes, packed: bytes, header: bytes) -> tuple[bytes, dict[str, str]]:
    data = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    if hashlib.sha256(data).digest() != address:
        raise ValueError("a payload does not match its address")
    fields = fields_of(header)
    if fields.get("warc-payload-digest") != "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode():
        raise ValueError("a payload does not match its record")
    return data, fields


def _number(urn: str | None) -> int | None:
    value = urn.rpartition(":")[2].rstrip(">") if urn else "null"
    return None if value == "null" else int(value)


def _restored(archive: Archive, schema: str, finish) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                rows = [finish(header, *_verified(address, packed, header)) for header, address, packed in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return archive.records.join(archive.payloads, "address").select("header", "address", "packed").mapInArrow(run, schema)


def read_records(archive: Archive) -> DataFrame:
    """(id, record_type, header, payload, record): every record restored. ``payload`` is the
    full one also for a revisit; ``record`` holds the exact bytes in a WARC file, in which a
    revisit has no block."""

    def finish(header, data, fields):
        kind = fields["warc-type"]
        return _number(fields["warc-record-id"]), kind, header, data, header + (b"" if kind == "revisit" else data) + b"\r\n\r\n"

    return _restored(archive, "id bigint, record_type string, header binary, payload binary, record binary", finish)


def read_digests(archive: Archive) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of every
    record, computed from the restored bytes."""

    def finish(header, data, fields):
        return _number(fields["warc-record-id"]), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), fields["warc-type"], _number(fields.get("warc-refers-to")), fields["warc-target-uri"]

    return _restored(archive, "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string", finish)

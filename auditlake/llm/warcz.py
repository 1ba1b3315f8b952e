"""WARC archives in Zstandard, one frame for each record.

An archive starts with a skippable frame that holds the dictionary all its
records were compressed with; each record is a frame of its own with its size
and checksum, so any record can be decoded alone. The reader loads the
dictionary, decodes frame by frame and checks versions, header fields, lengths
and digests.

Of records with equal payloads of at least ``least`` bytes, that with the
smallest page_id is written as a response and the others as revisits of it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import fresh_path, materialize, read_file, slices, write_file

DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in an archive before compression, at most (a larger record has its own).
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20


class Record(NamedTuple):
    """A record as read: WARC fields by lower-case name, HTTP fields likewise, and the payload."""

    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _head(first: bytes, fields: list[tuple[str, str]]) -> bytes:
    return b"".join([first, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n"])


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit without its payload."""
    http = _head(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", _clean(uri)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(VERSION, fields) + block + b"\r\n\r\n"


def encode_archive(records: list[bytes], samples: list[bytes]) -> bytes:
    """The archive of whole records; the dictionary is trained on ``samples`` if there are enough."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        trained = None
    press = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
    lead = []
    if trained:
        data = trained.as_bytes()
        lead = [struct.pack("<II", DICTIONARY_FRAME, len(data)), data]
    return b"".join([*lead, *map(press.compress, records)])


def _parse(text: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = text.split(b"\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header field: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def decode_record(data: bytes) -> Record:
    """Checks and splits the bytes of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, fields = _parse(head)
    if not gap or version != VERSION:
        raise ValueError(f"not a record of {VERSION.decode()}: {data[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record has no {name}")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"a record's length is not {size}")
    if fields["warc-type"] not in ("response", "revisit"):
        return Record(fields, {}, rest[:-4])
    http_head, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    status, http = _parse(http_head)
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("a record's block is no HTTP response")
    if fields["warc-type"] == "response":
        if http.get("content-length") != str(len(payload)):
            raise ValueError("a payload's length is wrong")
        if fields.get("warc-payload-digest") != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise ValueError("a payload's digest is wrong")
    elif payload or "warc-refers-to" not in fields:
        raise ValueError("a revisit has a payload, or refers to nothing")
    return Record(fields, http, payload)


def decode_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive, in turn."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary is cut short")
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        trained, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpack, view = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor(), memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("the archive ends within a frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + 16384]
            if not len(chunk):
                raise ValueError("the archive ends within a frame")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        yield decode_record(b"".join(parts))


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str, *, least: int = 100, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows (page_id, url, html) as archives; returns the manifest: path, records.

    A null html is an empty payload, a null url gives a record without target; a
    very long payload is one frame like any other, in an archive of its own if it
    is longer than ``archive_bytes``. An empty table gives no archives; other
    columns are not read.
    Rows with a null page_id are responses; so are all rows that bear the id of
    their payload's response.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    whole = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = whole.where(F.length("payload") >= least).select("page_id", "digest")
    first = materialize(long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first").drop("n")
    again = long.join(first, "digest").where("page_id != refers_to").distinct()
    again = materialize(again, "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        records: list[bytes] = []
        samples: list[bytes] = []
        made: list[tuple[str, int]] = []

        def flush() -> None:
            if records:
                path = f"{folder}/part-{name}-{len(made):05d}.warc.zst"
                write_file(path, encode_archive(records, samples))
                made.append((path, len(records)))
                records.clear()
                samples.clear()

        held = sampled = 0
        for batch in batches:
            for part in slices(batch, 128):
                for page, uri, body, digest, refers in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    record = encode_record(page, uri, body, digest, refers, date)
                    if held and held + len(record) > archive_bytes:
                        flush()
                        held = sampled = 0
                    records.append(record)
                    held += len(record)
                    if sampled < SAMPLE_BYTES:  # a dictionary learns from the archive's first records
                        samples.append(record[:8192])
                        sampled += len(samples[-1])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    joined = whole.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(joined.mapInArrow(run, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, rows, held = 0, [], 0
                for r in decode_archive(read_file(path)):
                    seen += 1
                    kind = r.fields["warc-type"]
                    response = kind == "response"
                    rows.append(
                        (
                            _page(r.fields["warc-record-id"]),
                            r.fields.get("warc-target-uri"),
                            r.payload if response else None,
                            int(r.http["content-length"]),
                            r.fields["warc-payload-digest"].removeprefix("sha256:"),
                            kind,
                            None if response else _page(r.fields["warc-refers-to"]),
                        )
                    )
                    held += len(r.payload)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)
                if seen != expected:
                    raise ValueError(f"{path} has {seen} records, not {expected}")

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.repartition(n, "path").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "archives"), **options))

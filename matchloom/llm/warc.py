"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some whole records, and a seek table in
a skippable frame at the end (the public "seekable format"). The index maps a record identifier to
bundle, frame and the record's offset within the frame, so that one record costs one frame to read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import renamed
from matchloom.session import materialise, scratch_path

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
REVISIT_BYTES = 1000
WARC_DATE = "2024-01-01T00:00:00Z"
RECORD_ID = "tag:matchloom.example,2024:page/"

# Fixed values of the seekable format: magic numbers, and the flag for checksums in the descriptor.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<III")

INDEX_SCHEMA = "record_id string, page_id long, path string, frame int, offset int, length int"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class BundleWriter:
    """Writes records to ``<folder>/<name>``; ``add`` returns a record's frame and offset there."""

    def __init__(self, folder: str, name: str, frame_bytes: int):
        import zstandard

        self.path = f"{folder}/{name}"
        store, place = _store(self.path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self._out = store.open_output_stream(place, compression=None)
        self._press = zstandard.ZstdCompressor(level=3)
        self._frame_bytes = frame_bytes
        self._buffer, self._entries, self.written = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self._buffer and len(self._buffer) + len(record) > self._frame_bytes:
            self._end_frame()
        place = len(self._entries), len(self._buffer)
        self._buffer += record
        return place

    def _end_frame(self) -> None:
        import xxhash

        data = bytes(self._buffer)
        frame = self._press.compress(data)
        self._out.write(frame)
        self.written += len(frame)
        self._entries.append(_ENTRY.pack(len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self._buffer.clear()

    def close(self) -> None:
        if self._buffer:
            self._end_frame()
        footer = _FOOTER.pack(len(self._entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        table = b"".join(self._entries) + footer
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self._out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, path: str):
        import zstandard

        store, place = _store(path)
        self._file = store.open_input_file(place)
        size = self._file.size()
        self._file.seek(size - _FOOTER.size)
        count, descriptor, magic = _FOOTER.unpack(self._file.read(_FOOTER.size))
        if magic != SEEKABLE_MAGIC or not descriptor & CHECKSUM_FLAG:
            raise ValueError(f"no seek table with checksums at the end of {path}")
        self._file.seek(size - _FOOTER.size - count * _ENTRY.size)
        self.frames, start = [], 0
        for packed, plain, check in _ENTRY.iter_unpack(self._file.read(count * _ENTRY.size)):
            self.frames.append((start, packed, plain, check))
            start += packed
        self._open = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        import xxhash

        start, packed, plain, check = self.frames[k]
        self._file.seek(start)
        data = self._open.decompressobj().decompress(self._file.read(packed))
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def close(self) -> None:
        self._file.close()


def _uri(url: str | None, other: str) -> str:
    if not url:
        return other
    return "".join(c if "\x20" < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def warc_record(
    page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool
) -> bytes:
    """One record. A revisit holds the HTTP header alone; its Content-Length there is the payload's."""
    own = f"{RECORD_ID}{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_uri(url, own)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{RECORD_ID}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in pairs}


def _page(record_id: str) -> int | None:
    page = record_id.strip("<>").removeprefix(RECORD_ID)
    return None if page == "None" else int(page)


def parse_record(record: bytes) -> tuple:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of one record; the
    digest of a payload that is there is worked out anew and must be the one in the header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    revisit = fields["warc-type"] == "revisit"
    size = int(_fields(http)["content-length"])
    if not revisit and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"{fields['warc-record-id']} is damaged")
    refers = _page(fields["warc-refers-to"]) if revisit else None
    return _page(fields["warc-record-id"]), size, digest.hex(), fields["warc-type"], refers, None if revisit else payload


def mark_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, html) with ``sha1`` and, for a revisit, ``refers_to``.

    Only digests that occur again are joined back: the counting combines copies ahead of the shuffle,
    and adaptive execution splits a digest that many pages share.
    """
    payload = F.encode("html", "utf-8")
    rows = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumns(
        {"sha1": F.sha1(payload), "_bytes": F.octet_length("html")}
    )
    long_enough = F.col("_bytes") >= least_bytes
    again = (
        rows.filter(long_enough)
        .groupBy("sha1", "_bytes")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("refers_to").isNotNull())
        .select(F.col("sha1").alias("_sha1"), F.col("_bytes").alias("_size"), "refers_to")
    )
    met = (F.col("sha1") == F.col("_sha1")) & (F.col("_bytes") == F.col("_size")) & long_enough
    first: Column = F.col("page_id").eqNullSafe(F.col("refers_to"))
    return (
        rows.join(again, met, "left")
        .withColumn("refers_to", F.when(~first, F.col("refers_to")))
        .select("page_id", "url", "html", "sha1", "refers_to")
    )


def write_bundles(
    pages: DataFrame,
    folder: str,
    least_bytes: int = REVISIT_BYTES,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) into bundles below ``folder``; the index.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is
    a response and the others revisit it. Every attempt of a task writes files of its own names, and the
    index, written as a table, names those of the attempts that counted: what a lost executor
    left behind is in no index. A task holds one frame at a time.

    Nulls: a null html is an empty payload, a null url is replaced by the record's identifier, a row with
    a null page_id never is what others refer to. Repeated rows with the largest page_id are all
    responses under one identifier. Records longer than a frame have a frame of their own. Empty table:
    no bundles, an empty index. Other columns are not looked at.
    """
    marked = mark_revisits(renamed(pages, page_id="page_id", url="url", html="html"), least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                payload, to = row["html"].encode("utf-8", "surrogatepass"), row["refers_to"]
                record = warc_record(
                    row["page_id"], row["url"], payload, bytes.fromhex(row["sha1"]), to, to is not None
                )
                if writer is None:
                    name = f"bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(folder, name, frame_bytes)
                frame, offset = writer.add(record)
                own = f"{RECORD_ID}{row['page_id']}"
                rows.append((own, row["page_id"], writer.path, frame, offset, len(record)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        if writer is not None:
            writer.close()

    return materialise(marked.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` names, read from their frames: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to`` and ``payload`` (null for revisits, or if not asked for). A frame is read
    once, whatever number of its records is asked for; other frames are not read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = frame = reader = data = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                if row["path"] != path:
                    if reader:
                        reader.close()
                    path, reader, frame = row["path"], BundleReader(row["path"]), None
                if row["frame"] != frame:
                    frame, data = row["frame"], reader.frame(row["frame"])
                found = parse_record(data[row["offset"] : row["offset"] + row["length"]])
                rows.append(found if payloads else (*found[:5], None))
                held += len(found[5] or b"") * payloads
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if reader:
            reader.close()

    near = index.repartition("path", "frame").sortWithinPartitions("path", "frame", "offset")
    return near.select("path", "frame", "offset", "length").mapInArrow(read, RECORD_SCHEMA)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to bundles in the shared folder and reads all their records back."""
    return read_records(write_bundles(pages, scratch_path(pages.sparkSession, "warc")), payloads=False)

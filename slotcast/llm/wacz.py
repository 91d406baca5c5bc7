"""WARC records in ZIP-packaged archives: written from pages, read back by range.

Writing. Every page is a record, its payload the html in UTF-8 (nothing where null). Of records
with equal payloads of at least `least` bytes, those with the smallest page_id are `response`, the
others `revisit` and name that page; shorter payloads are always `response`. Each record is a gzip
member of `archive/data.warc.gz`, which is stored in a ZIP together with `indexes/index.cdx`, a line
of offset and length per record. A task fills archives of about `ARCHIVE_BYTES` and writes each
under a name of its own attempt; the manifest, written as a table, names those that count, so
what a lost executor leaves behind is never read.

Reading. `Archive` reads the end-of-directory record (and its ZIP64 form) from the tail of the file,
the central directory, and the local header of a stored member. It then reads the index and each
record by its byte range; nothing is unpacked to disk and no archive is read whole. Payload digests
are checked on reading. Files are reached through `pyarrow.fs`, so the shared folder may be local, HDFS,
S3 or GCS.

Nulls: a null html is an empty payload; a null url leaves out the target; a null page_id leaves out
the id and never becomes the page that others refer to, unless it is the only one. Rows that share
page_id and payload are all `response`. An empty table makes no archive and no rows. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.sources.shared import drop_tables, new_path, settle

ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style folder name."""
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = theirs + uri[len(ours) :] if uri.startswith(ours) else uri
    return fs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record, uncompressed. A revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + payload_digest(payload),
        "X-Payload-Length": str(len(payload)),
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page": str(refers_to)}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Named fields, block and payload of one record; ValueError where the payload does not match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + payload_digest(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of page {fields.get('X-Page-ID')} does not match its digest")
    return {"fields": fields, "payload": payload}


def pack(records: list[tuple[bytes, str]], zip64: bool = False) -> bytes:
    """A ZIP of stored members: records as (gzip member, index key) and their index."""
    at, lines = 0, []
    for data, key in records:
        lines.append(f"{key} {json.dumps({'offset': at, 'length': len(data)})}\n")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name, parts in ((DATA, (d for d, _ in records)), (INDEX, (s.encode() for s in sorted(lines)))):
            with archive.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                for part in parts:
                    member.write(part)
    return out.getvalue()


class Archive:
    """Range reads of stored members of a ZIP file."""

    def __init__(self, file) -> None:
        self.file = file
        self.members = {name: (offset, size) for name, offset, size in self._directory()}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _directory(self) -> Iterator[tuple[str, int, int]]:
        total = self.file.size()
        tail_at = max(0, total - (1 << 16) - 22)
        tail = self._read(tail_at, total - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack_from("<H2I", tail, end + 10)
        if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
            locator = self._read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack_from("<3Q", record, 32)
        directory, p = self._read(at, size), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", directory, p + 10)[0]
            packed, plain, names, extras, comment = struct.unpack_from("<2I3H", directory, p + 20)
            offset = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + names].decode()
            extra, q = directory[p + 46 + names : p + 46 + names + extras], 0
            while q + 4 <= len(extra):
                tag, length = struct.unpack_from("<2H", extra, q)
                if tag == 1:  # 64-bit fields stand here for those that are all ones, in this order
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                q += 4 + length
            if method == 0 and packed == plain:
                yield name, offset, plain
            p += 46 + names + extras + comment

    def start(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many they are."""
        offset, size = self.members[name]
        header = self._read(offset, 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        names, extras = struct.unpack_from("<2H", header, 26)
        return offset + 30 + names + extras, size

    def index(self) -> Iterator[tuple[int, int]]:
        """Offset in the file and length of every record, in file order."""
        at, size = self.start(INDEX)
        base, room = self.start(DATA)
        places = []
        for line in self._read(at, size).decode().splitlines():
            place = json.loads(line[line.index("{") :])
            if place["offset"] + place["length"] > room:
                raise ValueError("the index points outside the member")
            places.append((base + place["offset"], place["length"]))
        yield from sorted(places)

    def record(self, at: int, length: int) -> dict:
        return parse_record(zlib.decompress(self._read(at, length), 31))


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, date: str):
    def run(batches):
        files, base = filesystem(folder)
        records: list[tuple[bytes, str]] = []
        size = 0

        def flush():
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            content = pack(records)
            with files.open_output_stream(path) as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [len(content)], "records": [len(records)]})

        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _gzip(record_bytes(page_id, url, (html or "").encode(), first, revisit, date))
                records.append((data, f"{page_id if page_id is not None else '-'}"))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    records, size = [], 0
        if records:
            yield flush()

    return run


def write_archives(
    pages: DataFrame, folder: str, *, page_id="page_id", url="url", html="html", least=0, date="2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write the archives into `folder` and return their manifest (path, bytes, records), itself a written table."""
    files, base = filesystem(folder)
    files.create_dir(base)
    content = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(content).alias("digest")
    )
    kept = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha1(content).alias("digest")).where(F.octet_length(content) >= least)
    firsts = kept.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    rows = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", "first", F.when(F.octet_length(content) >= least, revisit).otherwise(False).alias("revisit"))
    return settle(rows.mapInArrow(_writer(folder, date), "path string, bytes long, records long"), "manifest")


def _reader(folder: str):
    def run(batches):
        files, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.open_input_file(path) as file:
                    archive = Archive(file)
                    for at, length in archive.index():
                        fields = archive.record(at, length)["fields"]
                        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                        rows.append(
                            (
                                int(page) if page is not None else None,
                                int(fields["X-Payload-Length"]),
                                fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                                fields["WARC-Type"],
                                int(refers) if refers is not None else None,
                            )
                        )
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(_reader(folder), RECORD)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages, read all records back, delete the archives."""
    spark = pages.sparkSession
    folder = new_path(spark, "wacz")
    out = settle(read_archives(write_archives(pages, folder, **columns), folder), "records")
    drop_tables(spark, [folder])
    return out

"""WARC records in ZIP packages: a streaming writer, and a reader by central directory and ranges.

A package holds, all stored (not compressed by the ZIP): ``archive/data.warc.gz``, one gzip member a
record; ``indexes/index.cdxj``, one JSON line a record with its offset and length in that member; and
``datapackage.json``.  The reader parses the end records (ZIP64 ones where sizes or counts need them)
and the central directory, finds the stored members, and reads single records by their ranges; it never
extracts a member.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, small_enough

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_LEAST_REVISIT = 100


class ZipWriter:
    """Stored members written in one pass to a stream that cannot seek.

    Sizes follow each member in a data descriptor.  ZIP64 fields are written where a size, an offset
    or the count needs them, or always with ``zip64``."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        self.name, self.header, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # room for 64-bit sizes in the descriptor
        self._write(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0x808, 0, 0, 0x21, 0, _MAX32, _MAX32, len(self.name), len(extra)) + self.name + extra)
        self.start = self.at

    def write(self, raw: bytes) -> int:
        """Adds to the open member; gives the offset in it."""
        offset = self.size
        self.crc, self.size = zlib.crc32(raw, self.crc), self.size + len(raw)
        self._write(raw)
        return offset

    def end(self) -> None:
        self._write(struct.pack("<4sLQQ", b"PK\x07\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.header, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for name, header, crc, size in self.members:
            wide = [v for v in (size, size, header) if self.zip64 or v >= _MAX32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            cut = lambda v: _MAX32 if self.zip64 or v >= _MAX32 else v
            self._write(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0x808, 0, 0, 0x21, crc, cut(size), cut(size), len(name), len(extra), 0, 0, 0, 0, cut(header)) + name + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or n >= _MAX16 or size >= _MAX32 or start >= _MAX32:
            end = self.at
            self._write(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
            n, size, start = _MAX16, _MAX32, _MAX32
        self._write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, size, start, 0))


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    header: int


class ZipReader:
    """Members of a ZIP by its central directory; ``file`` has seek, read and size."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {m.name: m for m in self._directory()}

    def range(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError(f"range {at}+{n} is outside the package of {self.size} bytes")
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - _MAX16)
        tail = self.range(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature within a comment
        if at < 0:
            raise ValueError("no end of central directory")
        n, size, start = struct.unpack_from("<10xH2L", tail, at)
        where = tail_at + at
        if n == _MAX16 or size == _MAX32 or start == _MAX32:
            locator = self.range(where - 20, 20) if where >= 20 else b""
            if locator[:4] == b"PK\x06\x07":
                end = self.range(struct.unpack_from("<8xQ", locator)[0], 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                n, size, start = struct.unpack_from("<32x3Q", end)
        raw, at = self.range(start, size), 0
        for _ in range(n):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            method, crc, packed, plain, names, extras, comments, header = struct.unpack_from("<10xH4xLLL3H8xL", raw, at)
            name, extra = raw[at + 46 : at + 46 + names], raw[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    plain, packed, header = (next(wide) if v == _MAX32 else v for v in (plain, packed, header))
                extra = extra[4 + length :]
            yield Member(name.decode("utf-8"), method, crc, packed, header)
            at += 46 + names + extras + comments

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.range(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return m.header + 30 + sum(struct.unpack_from("<2H", head, 26))

    def member(self, name: str) -> bytes:
        return self.range(self.start(name), self.members[name].size)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or, with ``refers_to``, a revisit of that page's equal payload."""
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Page, type, target and payload facts of one WARC record; a response's digest is computed from its
    payload and must equal the header's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda v: int(v[len("<urn:x-page:") : -1]) if v and v != "<urn:x-page:>" else None
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return {"page_id": page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to", "")), "payload": payload if fields["warc-type"] == "response" else None, "target_uri": fields.get("warc-target-uri")}


def _write_packages(folder: str, roll: int, date: str, zip64: bool):
    """Writes a task's rows (page_id, url, payload, digest, refers_to) to packages of about ``roll``
    bytes under names that no other attempt uses; a row a finished package comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        z = out = None
        lines: list[str] = []

        def close() -> pa.RecordBatch:
            z.end()
            z.begin(INDEX)
            for at in range(0, len(lines), 10_000):
                z.write("".join(lines[at : at + 10_000]).encode())
            z.end()
            z.begin(PACKAGE)
            z.write(json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
            z.end()
            z.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([len(lines)], pa.int64())], ["package", "records"])

        for b in batches:
            for row in b.to_pylist():
                if z is None:
                    path = f"{top}/{uuid.uuid4().hex}.wacz"
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(path)
                    z, lines = ZipWriter(out, zip64), []
                    z.begin(DATA)
                record = warc_record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["refers_to"], date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = packer.compress(record) + packer.flush()
                lines.append(json.dumps({"page": row["page_id"], "url": row["url"], "offset": z.write(packed), "length": len(packed)}) + "\n")
                if z.size >= roll:
                    yield close()
                    z = None
        if z is not None:
            yield close()

    return run


def _read_packages(folder: str, payloads: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            for package, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(f"{top}/{package}") as file:
                    z = ZipReader(file)
                    start, size = z.start(DATA), z.members[DATA].size
                    index = z.member(INDEX).splitlines()
                    if len(index) != count:
                        raise ValueError(f"{package} has {len(index)} records, not {count}")
                    for at in range(0, len(index), 500):
                        rows = []
                        for line in index[at : at + 500]:
                            entry = json.loads(line)
                            if entry["offset"] + entry["length"] > size:
                                raise ValueError(f"{package}: a range beyond its member")
                            rows.append(parse_record(zlib.decompress(z.range(start + entry["offset"], entry["length"]), 31)))
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return run


def write_archives(pages: DataFrame, tables: Tables, roll: int = 64 << 20, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 500_000, zip64: bool = False) -> tuple[str, DataFrame]:
    """Writes a WARC record a row of ``pages`` (page_id, url, html); gives the folder of the packages and
    their list (package, records).

    Of records with equal payloads of 100 bytes or more, that with the smallest page_id is the response,
    the others revisit it.  Only (digest, page_id) goes through a shuffle, combined before it.  The
    digests that occur twice or more are broadcast up to ``broadcast_rows`` (counted first); more are
    joined by digest, where AQE splits hot ones.  The list is a written table of what succeeded: packages
    of lost or repeated attempts are not in it.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    equal = pages.where(F.length("payload") >= _LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    equal = tables.put("equal", equal.select(F.col("digest").alias("e_digest"), "first"))
    side = F.broadcast(equal) if small_enough(equal, broadcast_rows) else equal
    rows = pages.join(side, pages["digest"] == side["e_digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    folder = f"{tables.root}/packages"
    made = rows.select("page_id", "url", "payload", "digest", refers).mapInArrow(_write_packages(folder, roll, date, zip64), "package string, records long")
    return folder, tables.put("made", made)


def read_archives(folder: str, packages: DataFrame, payloads: bool = False, most_tasks: int = 50_000) -> DataFrame:
    """The records of listed packages: (page_id, payload_bytes, payload_digest, record_type, refers_to,
    target_uri[, payload]).  A task reads one package (several beyond ``most_tasks``), its records by
    range; the packages are counted and dealt by ranges of their names, which AQE doesn't merge."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string" + ", payload binary" * payloads
    tasks = max(1, min(packages.count(), most_tasks))
    return packages.repartitionByRange(tasks, F.col("package")).mapInArrow(_read_packages(folder, payloads), schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to packages and reads them back: one row a page.

    Defined cases: a null html is an empty payload; a null url has no target; a null page_id is never
    referred to and revisits a numbered page with an equal payload.  Rows that repeat the smallest
    page_id of a payload are all responses.  An empty table writes no package and gives no rows; other
    columns are ignored."""
    tables = Tables(pages.sparkSession, "wacz")
    return read_archives(*write_archives(pages, tables)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC records in ZIP-packaged archives: writing, and range-reading without extraction.

An archive is a ZIP file with two stored members: the WARC records one after the other, each a gzip member of its own,
and an index with a line for each record (id, offset, length). The reader finds the end record, and where that says so the ZIP64 end record, walks
the central directory, locates the data of the stored members from their local headers, and reads the index and single
records by byte range. Nothing is unpacked and no archive is read as a whole.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is a response and the
others are revisits that refer to it and carry headers only; smaller ones are all responses. Repeated rows of the page
that is the response are responses too.

Null html is an empty payload. A null url gives a record without a target, a null page_id an empty one, which reads back
as null; it never is what a revisit refers to. An empty table gives no archives. Other columns are not written.

Tasks write archives of about ``size`` bytes under names of their own and return them; what an attempt that failed has
left is never read. The list of archives is a table in the shared folder.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.tables import checkpoint, mapped, shared_folder

#: Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """The file system of an address and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlsplit(uri).scheme else (fs.LocalFileSystem(), uri)


# -- records ---------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit without payload if refers_to is given, as a gzip member."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (b"" if revisit else payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}"] if url is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """A record's fields and payload; of a response the digest and size are taken from the payload itself."""
    raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    revisit = f["warc-type"] == "revisit"
    digest = f["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
    if digest != f["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"the payload of {f['warc-record-id']} does not match its digest")
    return {"page_id": number(f["warc-record-id"]), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": number(f.get("warc-refers-to", "")), "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload), "payload_digest": digest, "payload": None if revisit else payload}


# -- ZIP -------------------------------------------------------------------------------------------------------------


def pack(records: list[tuple[str, bytes]]) -> bytes:
    """An archive of (id, record)."""
    lines, at = [], 0
    for name, raw in records:
        lines.append(f"{name} {at} {len(raw)}\n")
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for member, data in ((RECORDS, b"".join(raw for _, raw in records)), (INDEX, "".join(lines).encode())):
            z.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


class Archive:
    """A ZIP file whose stored members are read by byte range. file has size(), seek() and read()."""

    def __init__(self, file):
        self.file = file
        self.members = {name: (method, size, at) for name, method, size, at in self._directory(*self._end())}

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        raw = self.file.read(n)
        if len(raw) < n:
            raise ValueError("the archive ends too early")
        return raw

    def _end(self) -> tuple[int, int]:
        """Place and size of the central directory."""
        size = self.file.size()
        n = min(size, 22 + 65535 + 20)
        tail = self._at(size - n, n)
        i = tail.rfind(END)
        while i >= 0 and i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != n:  # not inside the comment
            i = tail.rfind(END, 0, i)
        if i < 0:
            raise ValueError("no ZIP archive")
        count, long, at = struct.unpack_from("<HII", tail, i + 10)
        if i >= 20 and tail[i - 20 : i - 16] == LOCATOR64 and (count == 0xFFFF or 0xFFFFFFFF in (long, at)):
            end = self._at(struct.unpack_from("<Q", tail, i - 12)[0], 56)
            if end[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            long, at = struct.unpack_from("<QQ", end, 40)
        return at, long

    def _directory(self, at: int, long: int) -> Iterator[tuple[str, int, int, int]]:
        raw, i = self._at(at, long), 0
        while i < long:
            if raw[i : i + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method, = struct.unpack_from("<H", raw, i + 10)
            packed, full, name, extra, comment = struct.unpack_from("<IIHHH", raw, i + 20)
            local, = struct.unpack_from("<I", raw, i + 42)
            j, end = i + 46 + name, i + 46 + name + extra
            while j + 4 <= end:
                kind, n = struct.unpack_from("<HH", raw, j)
                if kind == 1:  # ZIP64: only what did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", raw, j + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                j += 4 + n
            yield raw[i + 46 : i + 46 + name].decode(), method, packed, local
            i = end + comment

    def place(self, member: str) -> tuple[int, int]:
        """Where the data of a stored member begin, and their size."""
        method, size, local = self.members[member]
        if method != 0:
            raise ValueError(f"{member} is compressed; it has to be stored")
        head = self._at(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {member}")
        name, extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + name + extra, size

    def read(self, member: str, start: int = 0, n: int | None = None) -> bytes:
        at, size = self.place(member)
        n = size - start if n is None else n
        if start < 0 or n < 0 or start + n > size:
            raise ValueError(f"range outside {member}")
        return self._at(at + start, n)

    def index(self) -> list[tuple[str, int, int]]:
        return [(name, int(at), int(n)) for name, at, n in (x.rsplit(" ", 2) for x in self.read(INDEX).decode().splitlines())]


# -- tables ----------------------------------------------------------------------------------------------------------


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_digest, n_bytes, refers_to): refers_to of revisits alone."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), F.sha1(F.encode("html", "UTF-8")).alias("payload_digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    shared = rows.where(F.col("n_bytes") >= least).groupBy(F.col("payload_digest").alias("same"), F.col("n_bytes").alias("as_long")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").drop("n")
    joined = rows.join(shared, (rows["payload_digest"] == shared["same"]) & (rows["n_bytes"] == shared["as_long"]), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", "n_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000, size: int = 32 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(archive, n_records) of the archives written to folder, by default one of its own in the shared folder."""
    to = folder or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        n = 0

        def write() -> pa.RecordBatch:
            at = f"{to}/{uuid.uuid4().hex}.zip"
            fs, path = filesystem(at)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(pack(held))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([len(held)], pa.int64())], names=["archive", "n_records"])

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, long, refers = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "payload_digest", "n_bytes", "refers_to"))
                held.append(("" if page is None else str(page), record(page, url, payload, digest, long, refers, date)))
                n += len(held[-1][1])
                if n >= size:
                    yield write()
                    held.clear()
                    n = 0
        if held:
            yield write()

    return checkpoint(decided(pages, least).transform(mapped, run, "archive string, n_records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record of the archives."""
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column("archive").to_pylist():
                fs, path = filesystem(at)
                with fs.open_input_file(path) as file:
                    a = Archive(file)
                    first, size = a.place(RECORDS)
                    rows, n = [], 0
                    for _, start, long in a.index():
                        if start + long > size:
                            raise ValueError(f"the index of {at} points outside its records")
                        rows.append(parse(a._at(first + start, long)))
                        n += long
                        if n > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, n = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kind)

    return archives.select("archive").transform(mapped, run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary").select(*names)

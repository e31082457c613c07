"""WARC archives: written one gzip member per record, and read back sequentially.

Writing: each task writes archives of at most `archive_bytes` (compressed) under names of its own into a shared folder
and hands on their paths. The list of paths is a written table, so only archives of finished tasks are ever read; what
lost tasks left is ignored. Payloads are compared by SHA-1 digest; that of the largest id is a response, equal ones
revisit it and carry no payload.

Reading: a task streams an archive in chunks, inflates a chunk of one member at a time, frames the block by
Content-Length, and sums up block and payload digests (of any kind that hashlib has, in base32 or hexadecimal) as the
bytes go by. It holds a chunk, the message's headers and, if they are asked for, one payload. Records of all types are
read. Damage fails the job, or is a row that says so, after which reading goes on with the next member.

Archives are opened by pyarrow's file systems, so the shared folder may be any that pyarrow and Spark both know.

Defined results: a null payload counts as empty; a null id is below all others (revisits of it have a null
refers_to); rows that repeat both the id and the payload are all responses if they are the largest; an empty table
gives no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import BROADCAST_ROWS, cut, join_dealt, shared_path, sized

#: Bytes read or inflated at a time.
CHUNK = 1 << 18
#: Bytes that a record's own headers may have, about.
HEADER = 1 << 20
MAGIC = b"\x1f\x8b\x08"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, payload binary, error string"


class WarcError(ValueError):
    """An archive that breaks the format or whose digests don't match."""


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, is_response: bool, date: str) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    name = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join((url or "urn:x-none").split()),
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not is_response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Inflated:
    """A gzip stream's members, inflated a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.buffer = stream, b"", bytearray()
        self.inflate = zlib.decompressobj(31)

    def begin(self) -> bool:
        """Goes to the next member; False if there's none."""
        self.raw = self.raw or self.stream.read(CHUNK)
        self.buffer.clear()
        self.inflate = zlib.decompressobj(31)
        return bool(self.raw)

    def fill(self) -> bool:
        """Inflates some more of the member; False at its end."""
        if self.inflate.eof:
            return False
        data = self.raw or self.stream.read(CHUNK)
        self.buffer += self.inflate.decompress(data, CHUNK) if data else self.inflate.flush()
        if not data and not self.inflate.eof:
            raise WarcError("the archive ends inside a record")
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before a mark, which is passed over."""
        while (i := self.buffer.find(mark)) < 0:
            if len(self.buffer) > HEADER or not self.fill():
                raise WarcError("no WARC header")
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next bytes, a chunk at a time."""
        while size:
            if not self.buffer and not self.fill():
                raise WarcError("Content-Length doesn't frame the block")
            part = bytes(self.buffer[:size])
            del self.buffer[: len(part)]
            size -= len(part)
            if part:
                yield part

    def finish(self) -> None:
        """Checks that what's left of the member is a record's end."""
        while len(self.buffer) <= 4 and self.fill():
            pass
        if self.buffer != b"\r\n\r\n":
            raise WarcError("Content-Length doesn't frame the block")

    def skip(self) -> None:
        """Leaves a damaged member: to its end, or where it can't be inflated, to what looks like the next one."""
        try:
            while True:
                self.buffer.clear()
                if not self.fill():
                    return
        except (WarcError, zlib.error):
            self.raw = self.raw[1:]
        while (i := self.raw.find(MAGIC)) < 0:
            more = self.stream.read(CHUNK)
            if not more:
                self.raw = b""
                return
            self.raw = self.raw[-2:] + more
        self.raw = self.raw[i:]


def _agrees(said: str | None, name: str, sums: dict) -> None:
    """Raises if a digest, in base32 or hexadecimal of whatever case, isn't the data's; unknown kinds aren't checked."""
    kind, _, value = (said or "").partition(":")
    if (found := sums.get(kind.strip().lower().replace("-", ""))) is None:
        return
    raw, value = found.digest(), value.strip().rstrip("=")
    if value.lower() != raw.hex() and value.upper() != base64.b32encode(raw).decode().rstrip("="):
        raise WarcError(f"the {name}'s digest isn't {said}")


def _sums(said: str | None) -> dict:
    kind = (said or "").partition(":")[0].strip().lower().replace("-", "")
    return {kind: hashlib.new(kind)} if kind in hashlib.algorithms_available and not kind.startswith("shake") else {}


def _record(source: Inflated, payloads: bool) -> dict:
    """The record that a member holds: its headers (lower-case names), payload if asked for, and the payload's length.

    The payload of an HTTP message is what follows its headers, that of other blocks the whole block. A response is
    checked against the length that it declares; of a revisit, which has no payload, that length is the payload's.
    """
    lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size, kind = fields.get("content-length", ""), fields.get("warc-type")
    if not size.isdigit() or kind is None:
        raise WarcError("no Content-Length or no WARC-Type")
    whole, own = _sums(fields.get("warc-block-digest")), _sums(fields.get("warc-payload-digest"))
    http: bytearray | None = bytearray() if fields.get("content-type", "").lower().startswith("application/http") else None
    kept, length, declared = [], 0, None
    for part in source.take(int(size)):
        for x in whole.values():
            x.update(part)
        if http is not None:
            http += part
            head, sep, part = bytes(http).partition(b"\r\n\r\n")
            if not sep:
                continue
            declared = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
            http = None
        length += len(part)
        for x in own.values():
            x.update(part)
        if payloads:
            kept.append(part)
    source.finish()
    _agrees(fields.get("warc-block-digest"), "block", whole)
    if kind != "revisit":
        if kind == "response" and declared is not None and declared != length:
            raise WarcError("the payload isn't as long as the response says")
        _agrees(fields.get("warc-payload-digest"), "payload", own)
    return {"fields": fields, "payload": b"".join(kept) if payloads else None, "payload_bytes": declared if kind == "revisit" and declared is not None else length}


def records(stream, payloads: bool = True, damaged: bool = False) -> Iterator[dict]:
    """The records of a gzip stream, in order. Damage raises a WarcError or, if `damaged` are asked for, makes a record
    {"error": what's wrong}, and reading goes on with the next member."""
    source = Inflated(stream)
    while source.begin():
        try:
            yield _record(source, payloads)
        except (WarcError, zlib.error) as e:
            if not damaged:
                raise WarcError(str(e)) from e
            yield {"error": str(e)}
            source.skip()


def parse(data: bytes) -> dict:
    """The record that data, uncompressed, is."""
    return next(records(io.BytesIO(gzip_member(data, 1))))


def _file(path: str):
    return pafs.FileSystem.from_uri(path)


def _writer(folder: str, level: int, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, paths = None, "", 0, []
        for b in batches:
            for page_id, url, html, is_response, refers_to in zip(*(b.column(i) for i in range(5)), strict=True):
                payload = (html.as_py() or "").encode()
                data = gzip_member(record(page_id.as_py(), url.as_py(), payload, digest(payload), refers_to.as_py(), is_response.as_py(), date), level)
                if out is None or size + len(data) > archive_bytes:
                    if out:
                        out.close()
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    paths.append(f"{folder}/{name}")
                out.write(data)
                size += len(data)
        if out:
            out.close()
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths)], names=["path"])

    return run


def _reader(payloads: bool, damaged: bool):
    schema = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def number(name: str | None) -> int | None:
        found = (name or "").rpartition("urn:x-page:")[2].rstrip(">")
        return int(found) if found.removeprefix("-").isdigit() else None

    def row(r: dict) -> tuple:
        if "error" in r:
            return (None,) * 8 + (r["error"],)
        f = r["fields"]
        return (number(f.get("warc-record-id")), r["payload_bytes"], f.get("warc-payload-digest", "").removeprefix("sha1:"), f["warc-type"], number(f.get("warc-refers-to")), f.get("warc-target-uri"), f.get("warc-date"), r["payload"], None)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _file(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for r in records(stream, payloads, damaged):
                        rows.append(row(r))
                        held += 200 + len(r.get("payload") or b"")
                        if held > CHUNK:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def plan(pages: DataFrame, min_bytes: int = 0, rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, is_response, refers_to: what each page's record is.

    Digests that several pages share are few or many: their table is counted, and broadcast only if it's small;
    otherwise the join is a shuffle by digest, with the pages of a hot one dealt out over as many parts as they call for.
    """
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    p = pages.select("page_id", "url", "html", sha.alias("sha"))
    long_enough = F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes
    shared = p.where(long_enough).groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    shared = cut(shared.withColumn("shared", F.lit(True)), "shared-digests")
    small = sized(shared, rows)
    j = join_dealt(p, shared, ["sha"], "n", ["page_id", "url"], "left") if small is shared else p.join(small, "sha", "left")
    first = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("largest"))
    return j.select("page_id", "url", "html", first.alias("is_response"), F.when(~first, F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6, archive_bytes: int = 64 << 20, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into archives in folder; their paths, as a table."""
    return cut(plan(pages, min_bytes).mapInArrow(_writer(folder, level, archive_bytes, date), "path string"), "archives")


def read(paths: DataFrame, payloads: bool = True, damaged: bool = False) -> DataFrame:
    """The records of the archives in paths (a column path), checked; an archive is read by one task.

    A damaged record fails the job or, if `damaged` are asked for, is a row with nothing but an error.
    """
    n = max(1, min(paths.count(), 10_000))
    return paths.select("path").repartition(n, "path").mapInArrow(_reader(payloads, damaged), RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back."""
    folder = shared_path(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes, level), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def local_archives(folder: str) -> list[str]:
    """Paths of a local folder's archives."""
    return [f"file://{os.path.abspath(folder)}/{x}" for x in sorted(os.listdir(folder)) if x.endswith(".warc.gz")]

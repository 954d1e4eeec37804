"""WARC archives: written one gzip member a record, and read back by a sequential reader.

The reader takes a stream in small pieces, inflates one member at a time, frames each record by its Content-Length and
verifies the digests of block and payload. It holds one record in memory at most.

Writing keeps one response of each payload, that with the smallest id; the others become revisit records of it, which hold HTTP
headers only. Archives are files of bounded size in the folder that driver and executors share. The manifest
names the files of the attempts that succeeded, so a repeated task leaves nothing but a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, shared_dir, small_batches

#: Bytes of payload after which a new archive begins.
ROLL = 16 << 20
LEVEL = 1
PIECE = 1 << 16
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
NAME = "urn:docharbor:page:"
#: Records of payloads of fewer bytes than this are never revisits.
MIN_BYTES = 0


def digest(data: bytes) -> str:
    """Base32 SHA-1, as WARC writes it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def type(self) -> str:
        return self.headers["warc-type"]


def _uri(url: str) -> str:
    """Without white space and control characters, which would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, level: int = LEVEL) -> bytes:
    """One record as a gzip member: a response, or with refers_to a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in b" \t" and line and last:  # a folded line goes on with the last field
            out[last] += " " + line.decode("utf-8", "replace").strip()
        elif b":" in line:
            name, value = line.split(b":", 1)
            last = name.decode("utf-8", "replace").strip().lower()
            out[last] = value.decode("utf-8", "replace").strip()
    return out


class Members:
    """The members of a gzip stream, each as a source of inflated bytes."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def __iter__(self) -> Iterator[_Member]:
        while self.rest or self._more():
            member = _Member(self)
            yield member
            member.end()

    def _more(self) -> bool:
        self.rest = self.stream.read(PIECE)
        return bool(self.rest)


class _Member:
    def __init__(self, of: Members):
        self.of, self.z, self.held = of, zlib.decompressobj(31), bytearray()

    def _inflate(self) -> bool:
        """More bytes into held; False at the member's end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.of.rest
            if not data and not self.of._more():
                raise EOFError("the archive ends inside a gzip member")
            data = data or self.of.rest
            self.of.rest = b""
            got = self.z.decompress(data, PIECE)
            if self.z.eof:
                self.of.rest = self.z.unused_data
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            if len(self.held) > most:
                raise ValueError("a record's header has no end")
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._inflate():
                raise EOFError("a record's header is cut off")
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._inflate():
                raise EOFError("a record's block is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def end(self) -> None:
        """To the member's end, where nothing but the closing line ends may be left."""
        while self._inflate():
            pass
        if bytes(self.held).strip(b"\r\n"):
            raise ValueError("a gzip member holds more than its record")


def read_records(stream, verify: bool = True) -> Iterator[Record]:
    """The records of a stream with read(n), in order. Raises ValueError if a digest or the framing is wrong, EOFError if it is cut off."""
    for member in Members(stream):
        lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        headers = _fields(lines[1:])
        block = member.take(int(headers["content-length"]))
        http, payload = {}, block
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = _fields(head.split(b"\r\n")[1:])
        if verify:
            if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest(block)}":
                raise ValueError(f"block digest of {headers.get('warc-record-id')} is wrong")
            if headers["warc-type"] != "revisit" and "warc-payload-digest" in headers and headers["warc-payload-digest"] != f"sha1:{digest(payload)}":
                raise ValueError(f"payload digest of {headers.get('warc-record-id')} is wrong")
        yield Record(headers, http, payload)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes a record for each row; returns the manifest: path, n_records, n_bytes (compressed).

    A null payload is empty, a null url leaves its header out, a null id is an empty one. Of rows with equal payloads
    of at least min_bytes those with the smallest id are responses (all with that id, and those without an id if
    none has one), the rest revisits. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    folder = (folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").replace("file:/", "file:///").replace("file://///", "file:///")
    data = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), data.alias("payload"), F.sha1(data).alias("sha"))
    seen = Written(rows.where(F.octet_length("payload") >= min_bytes).select("id", "sha"), "warc-digests").df
    first = seen.groupBy("sha").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = seen.join(first, "sha").where("refers_to is not null and not (id <=> refers_to)").distinct()
    plan = rows.join(again.withColumnRenamed("id", "aid").withColumnRenamed("sha", "asha"), F.col("id").eqNullSafe(F.col("aid")) & (F.col("sha") == F.col("asha")), "left")

    def run(batches):
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        out, done, n, size, held = None, [], 0, 0, 0

        def close():
            nonlocal out, n, size, held
            if out is not None:
                out.close()
                done.append((name, n, size))
            out, n, size, held = None, 0, 0, 0

        for batch in batches:
            for i, u, p, r in zip(*(batch.column(c) for c in range(4)), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                body = p.as_py()
                got = record_bytes(i.as_py(), u.as_py(), body, r.as_py())
                out.write(got)
                n, size, held = n + 1, size + len(got), held + len(body)
                if held >= ROLL:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return Written(plan.select("id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest").df


def _page(name: str | None) -> int | None:
    tail = (name or "").strip("<>").removeprefix(NAME)
    return int(tail) if tail else None


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the files in column path, digests verified: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and the payload if asked for (null for a revisit). An archive is one task's work: files are of bounded size."""
    small_batches(spark, 500)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for rec in read_records(stream):
                        revisit = rec.type == "revisit"
                        size = int(rec.http["content-length"])
                        if not revisit and size != len(rec.payload):
                            raise ValueError(f"{path}: payload of {len(rec.payload)} bytes, not {size}")
                        rows.append((_page(rec.headers["warc-record-id"]), rec.headers.get("warc-target-uri"), size, rec.headers["warc-payload-digest"].removeprefix("sha1:"), rec.type, _page(rec.headers.get("warc-refers-to")), None if revisit or not payloads else rec.payload))
                        held += len(rec.payload) if payloads else 0
                        if len(rows) >= 500 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, manifest.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return manifest.select("path").repartition(n, "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes the archives of pages and reads them back."""
    return read_archives(pages.sparkSession, write_archives(pages, **columns))

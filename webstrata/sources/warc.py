"""WARC 1.1 files as a Spark data source, and CDXJ index lines.

Reading: spark.read.format("warc").load(path) gives one row per record, a task for each file. Writing: df.write.format("warc").mode("append").save(folder)
needs url, status, headers, body and captured_at; where there is a request_method (with request_headers and request_body), the request is a record behind its response and names it. Each task
writes one gzip file with a member per record under a temporary name and the driver renames the files of tasks that ended.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import urls

SCHEMA = "type string, url string, date string, content_type string, block binary, digest string, file string, offset long, record_id string, concurrent_to string"
BODY_ONLY = {"content-encoding", "transfer-encoding", "content-length"}


def http_payload(status: int, headers: dict[str, str], body: bytes) -> bytes:
    """Response bytes without the encodings that no longer hold; the length is that of the body."""
    lines = [f"HTTP/1.1 {status} {'OK' if status == 200 else ''}".rstrip()]
    lines += [f"{k}: {v}" for k, v in sorted(headers.items()) if k.lower() not in BODY_ONLY]
    return ("\r\n".join([*lines, f"content-length: {len(body)}"]) + "\r\n\r\n").encode() + body


def http_request(method: str, url: str, headers: dict[str, str], body: bytes) -> bytes:
    """Request bytes: the target is the path and query, the host a header, and a body comes with its own length."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    at = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    target = rest[at:] if rest[at : at + 1] == "/" else "/" + rest[at:]
    lines = [f"{method} {target} HTTP/1.1", f"Host: {rest[:at]}"]
    lines += [f"{k}: {v}" for k, v in sorted(headers.items()) if k.lower() not in BODY_ONLY | {"host"}]
    lines += [f"content-length: {len(body)}"] * bool(body)
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body


def record_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One gzip member: WARC headers, then the block, with its SHA-256 in base64."""
    digest = "sha256:" + base64.b64encode(hashlib.sha256(block).digest()).decode()
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(), **fields, "WARC-Block-Digest": digest, "Content-Length": str(len(block))}
    return gzip.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n", mtime=0)


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def member_of(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of the bytes of one gzip member. ValueError where they aren't a whole record."""
    unpack = zlib.decompressobj(wbits=31)
    try:
        found = _parsed(unpack.decompress(data))
    except zlib.error as e:
        raise ValueError("not a gzip member") from e
    if found is None or not unpack.eof:
        raise ValueError("not a whole WARC record")
    return found


def read_members(stream, block: int = 1 << 20) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each member of a binary stream; one member is held at a time. ValueError on a record that breaks off."""
    at, ahead = 0, stream.read(block)
    while ahead:
        unpack, raw, used = zlib.decompressobj(wbits=31), bytearray(), 0
        while ahead and not unpack.eof:
            raw += unpack.decompress(ahead)
            used += len(ahead) - len(unpack.unused_data)
            ahead = unpack.unused_data or stream.read(block)
        found = _parsed(bytes(raw)) if unpack.eof else None
        if found is None:
            raise ValueError(f"no whole WARC record at {at}")
        yield at, *found
        at += used


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def files_of(path: str, endings: tuple[str, ...]) -> list[str]:
    """A file, or the files of a folder with one of the endings."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    return [scheme + f.path for f in files if f.path.endswith(endings)]


@dataclass
class File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(f) for f in files_of(self.path, (".warc.gz", ".warc"))]

    def read(self, partition: File) -> Iterator[tuple]:
        store, at = _store(partition.path)
        with store.open_input_stream(at, compression=None) as f:
            for offset, h, block in read_members(f):
                yield h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), block, h.get("warc-block-digest"), partition.path, offset, h.get("warc-record-id"), h.get("warc-concurrent-to")


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    rows: int


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        name, n = f"{at}/.{uuid.uuid4().hex}.part", 0
        with store.open_output_stream(name, compression=None) as f:
            f.write(warc_record("warcinfo", {"Content-Type": "application/warc-fields"}, b"software: webstrata\r\n"))
            for row in rows:
                r = row.asDict()
                date = r["captured_at"].strftime("%Y-%m-%dT%H:%M:%SZ") if r["captured_at"] else "1970-01-01T00:00:00Z"
                own = record_id()
                fields = {"WARC-Record-ID": own, "WARC-Target-URI": r["url"] or "", "WARC-Date": date, "Content-Type": "application/http; msgtype=response"}
                f.write(warc_record("response", fields, http_payload(r["status"] or 200, dict(r["headers"] or {}), bytes(r["body"] or b""))))
                if r.get("request_method"):
                    asked = http_request(r["request_method"], r["url"] or "", dict(r.get("request_headers") or {}), bytes(r.get("request_body") or b""))
                    fields = {"WARC-Target-URI": r["url"] or "", "WARC-Date": date, "WARC-Concurrent-To": own, "Content-Type": "application/http; msgtype=request"}
                    f.write(warc_record("request", fields, asked))
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m and m.temporary:
                store.move(m.temporary, f"{at}/part-{uuid.uuid4().hex}.warc.gz")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and m.temporary:
                store.delete_file(m.temporary)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def cdxj(records: DataFrame) -> DataFrame:
    """(line): sorted index lines of response records (url, captured_at, mime_type, status, digest, file, offset)."""
    stamp = urls.timestamp14(F.col("captured_at"))
    entry = F.to_json(F.struct("url", F.col("mime_type").alias("mime"), F.col("status").cast("string").alias("status"), "digest", F.col("offset").cast("string").alias("offset"), F.col("file").alias("filename")))
    return records.select(F.concat_ws(" ", urls.surt_key(F.col("url")), stamp, entry).alias("line")).orderBy("line")

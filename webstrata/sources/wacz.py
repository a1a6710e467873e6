"""WACZ packages that are read through their index.

A package is a zip file of stored entries: archive/data.warc.gz with one gzip member for each record, indexes/index.cdxj with the place of each member,
pages/pages.jsonl, and datapackage.json with the sizes and SHA-256 of the others. A member's bytes can be read by themselves: the index says where
they begin in the entry, the zip directory where the entry begins in the file.

A package is written by one task from rows sorted by SURT key, so the index comes out sorted and only its compressed lines are held. An archive whose bodies
have more than ``most_bytes`` becomes several packages, each whole by itself, dealt by URL; so no task grows with an archive.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .shared import cut, shared_dir
from .warc import _store, http_payload, member_of, warc_record

DATA, INDEX, PAGES = "archive/data.warc.gz", "indexes/index.cdxj", "pages/pages.jsonl"
EPOCH = "1970-01-01T00:00:00Z"
#: order of the rows of a package: what it is about, its records, its pages
ABOUT, RECORD, PAGE = 0, 1, 2
_COLUMNS = ["archive_id", "part", "kind", "surt", "stamp", "date", "url", "title", "status", "headers", "mime_type", "body", "id"]


class _Entry:
    """A stored zip entry that is written bit by bit, with its size and hash."""

    def __init__(self, package: zipfile.ZipFile, name: str):
        self.out, self.name, self.size, self.hash = package.open(zipfile.ZipInfo(name), "w", force_zip64=True), name, 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> dict:
        self.out.close()
        return {"name": self.name.rsplit("/", 1)[-1], "path": self.name, "hash": f"sha256:{self.hash.hexdigest()}", "bytes": self.size}


class _Package:
    def __init__(self, stream):
        self.zip, self.about, self.resources, self.records, self.pages = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), {}, [], 0, 0
        self.entry, self.lines, self.packer = _Entry(self.zip, DATA), [], zlib.compressobj()

    def record(self, r: dict) -> None:
        fields = {"WARC-Target-URI": r["url"] or "", "WARC-Date": r["date"] or EPOCH, "Content-Type": "application/http; msgtype=response"}
        data = warc_record("response", fields, http_payload(r["status"], dict(r["headers"] or []), r["body"] or b""))
        place = {"url": r["url"], "mime": (r["mime_type"] or "").split(";")[0], "status": str(r["status"]), "length": str(len(data)), "offset": str(self.entry.size), "filename": DATA.rsplit("/", 1)[-1]}
        self.entry.write(data)
        self.lines.append(self.packer.compress(f"{r['surt']} {r['stamp']} {json.dumps(place, ensure_ascii=False)}\n".encode()))
        self.records += 1

    def _records_end(self) -> None:
        self.resources.append(self.entry.close())
        self.entry, unpack = _Entry(self.zip, INDEX), zlib.decompressobj()
        for x in [*self.lines, self.packer.flush()]:
            self.entry.write(unpack.decompress(x))
        self.resources.append(self.entry.close())
        self.entry = _Entry(self.zip, PAGES)
        self.entry.write(json.dumps({"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}).encode() + b"\n")

    def page(self, r: dict) -> None:
        if self.entry.name == DATA:
            self._records_end()
        self.entry.write(json.dumps({"id": r["id"], "url": r["url"], "ts": r["date"] or EPOCH, "title": r["title"] or ""}, ensure_ascii=False).encode() + b"\n")
        self.pages += 1

    def close(self) -> None:
        if self.entry.name == DATA:
            self._records_end()
        self.resources.append(self.entry.close())
        about = {"title": self.about.get("title") or self.about.get("url") or "", "mainPageUrl": self.about.get("url"), "mainPageDate": self.about.get("date") or EPOCH}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", **about, "resources": self.resources}, ensure_ascii=False))
        self.zip.close()


def write_wacz(archives: DataFrame, records: DataFrame, pages: DataFrame, folder: str | None = None, most_bytes: int = 1 << 30) -> DataFrame:
    """Write the packages of ``archives`` (archive_id, title, start_url, main_date); returns (archive_id, part, path, records, pages).

    records: archive_id, url, captured_at, status, headers (map), mime_type, body. pages: archive_id, url, captured_at, title. Archives without
    records or pages are packages too; rows of archives that aren't listed are left out. Null dates are 1970, null bodies empty, a null status is 200.
    """
    folder = folder or shared_dir(archives.sparkSession)
    date = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = lambda c: F.coalesce(urls.timestamp14(c), F.lit("19700101000000"))
    none = {"part": "int", "surt": "string", "stamp": "string", "date": "string", "url": "string", "title": "string", "status": "int", "headers": "map<string,string>", "mime_type": "string", "body": "binary", "id": "string"}

    def rows(df: DataFrame, kind: int, **columns) -> DataFrame:
        filled = {"archive_id": F.col("archive_id").cast("long"), "kind": F.lit(kind), **{k: F.lit(None).cast(t) for k, t in none.items()}, **columns}
        return df.select(*[filled[c].alias(c) for c in _COLUMNS])

    key = urls.surt_key(F.col("url"))
    made = rows(records, RECORD, surt=F.coalesce(key, F.col("url")), stamp=stamp("captured_at"), date=date("captured_at"), url=F.col("url"), status=F.coalesce(F.col("status").cast("int"), F.lit(200)), headers=F.col("headers"), mime_type=F.col("mime_type"), body=F.col("body"))
    listed = rows(pages, PAGE, surt=F.coalesce(key, F.col("url")), date=date("captured_at"), url=F.col("url"), title=F.col("title"), id=F.md5(F.concat_ws(" ", "url", F.col("captured_at").cast("string"))))
    sizes = records.groupBy(F.col("archive_id").cast("long").alias("archive_id")).agg(F.sum(F.coalesce(F.octet_length("body"), F.lit(0)) + 512).alias("bytes"))
    parts = archives.select(F.col("archive_id").cast("long").alias("archive_id"), "title", "start_url", "main_date").join(sizes, "archive_id", "left")
    parts = cut(parts.withColumn("parts", F.greatest(F.ceil(F.coalesce("bytes", F.lit(0)) / most_bytes), F.lit(1)).cast("int")))
    dealt = made.unionByName(listed).join(parts.select("archive_id", "parts"), "archive_id")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("surt"), F.col("parts")).cast("int")).select(*_COLUMNS)
    heads = rows(parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ABOUT, part=F.col("part"), url=F.col("start_url"), title=F.col("title"), date=date("main_date"))
    ordered = dealt.unionByName(heads).repartition("archive_id", "part").sortWithinPartitions("archive_id", "part", "kind", "surt", "stamp", "url", "status")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        now, package, stream, done = None, None, None, []

        def finish() -> None:
            if package is not None:
                package.close()
                stream.close()
                done.append((*now, path, package.records, package.pages))

        for batch in batches:
            for one in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                for r in one.to_pylist():
                    if (r["archive_id"], r["part"]) != now:
                        finish()
                        now = r["archive_id"], r["part"]
                        name = f"{now[0]}-{now[1]}-{uuid.uuid4().hex}.wacz"
                        path, stream = f"{folder}/{name}", store.open_output_stream(f"{at}/{name}", compression=None)
                        package = _Package(stream)
                    if r["kind"] == ABOUT:
                        package.about = r
                    elif r["kind"] == RECORD:
                        package.record(r)
                    else:
                        package.page(r)
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive_id", "part", "path", "records", "pages"])

    return cut(ordered.mapInArrow(write, "archive_id long, part int, path string, records long, pages long"))


LINES = "archive_id long, path string, entry string, number long, line string"


def read_lines(packages: DataFrame, entries: list[str] | None = None) -> DataFrame:
    """(archive_id, path, entry, number, line) of the text entries of packages (archive_id, path); the data isn't opened."""
    wanted = entries or [INDEX, PAGES, "datapackage.json"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _store(path)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    for name in wanted:
                        with z.open(name) as entry:
                            lines, first = [], 0
                            for line in entry:
                                lines.append(line.decode().rstrip("\n"))
                                if len(lines) == 10_000:
                                    yield _lines(archive, path, name, first, lines)
                                    first, lines = first + len(lines), []
                            yield _lines(archive, path, name, first, lines)

    return packages.select("archive_id", "path").repartition("path").mapInArrow(read, LINES)


def _lines(archive: int, path: str, name: str, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([archive] * n, pa.int64()), pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], names=["archive_id", "path", "entry", "number", "line"])


def verified(packages: DataFrame) -> DataFrame:
    """(archive_id, path, entry, whole): whether the bytes of each entry, the data too, have the size and hash that datapackage.json gives. Entries are read in pieces."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _store(path)
                with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    found = []
                    for r in json.loads(z.read("datapackage.json"))["resources"]:
                        digest, size = hashlib.sha256(), 0
                        try:
                            with z.open(r["path"]) as entry:
                                while piece := entry.read(1 << 20):
                                    digest.update(piece)
                                    size += len(piece)
                        except zipfile.BadZipFile:  # the checksum of the zip file itself
                            size = -1
                        found.append((archive, path, r["path"], (f"sha256:{digest.hexdigest()}", size) == (r["hash"], r["bytes"])))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["archive_id", "path", "entry", "whole"])

    return packages.select("archive_id", "path").repartition("path").mapInArrow(read, "archive_id long, path string, entry string, whole boolean")


def read_index(packages: DataFrame) -> DataFrame:
    """(archive_id, path, surt, stamp, url, mime, status, length, offset, filename) from the index of packages."""
    lines = read_lines(packages, [INDEX])
    entry = F.from_json(F.regexp_extract("line", r"^\S+ \d+ (.*)$", 1), "url string, mime string, status string, length string, offset string, filename string")
    out = lines.select("archive_id", "path", F.regexp_extract("line", r"^(\S+) ", 1).alias("surt"), F.regexp_extract("line", r"^\S+ (\d+) ", 1).alias("stamp"), entry.alias("e"))
    return out.select("archive_id", "path", "surt", "stamp", "e.url", "e.mime", F.col("e.status").cast("int").alias("status"), F.col("e.length").cast("long").alias("length"), F.col("e.offset").cast("long").alias("offset"), "e.filename")


SPREAD = 64 << 20


def fetch(index: DataFrame) -> DataFrame:
    """``index`` rows (of ``read_index``, filtered as one likes) with date, headers (as text) and body of their records.

    Only the directory of a package and the bytes of the wanted members are read. Rows are dealt by package and stretch of its data, so a large package is read by many tasks.
    """
    columns = ["archive_id", "path", "surt", "stamp", "url", "mime", "status", "length", "offset", "filename"]
    rows = index.select(*columns)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, begins = None, None, {}
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = []
                for path, offset, length, name in zip(*[part.column(c).to_pylist() for c in ("path", "offset", "length", "filename")], strict=True):
                    if path != now:
                        if f is not None:
                            f.close()
                        store, at = _store(path)
                        now, f = path, store.open_input_file(at)
                        with zipfile.ZipFile(f) as z:
                            begins = {i.filename: i.header_offset for i in z.infolist()}
                        f = store.open_input_file(at)
                    head = begins[f"archive/{name}"]
                    f.seek(head)
                    local = f.read(30)
                    f.seek(head + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little") + offset)
                    fields, block = member_of(f.read(length))
                    http, _, body = block.partition(b"\r\n\r\n")
                    found.append((fields.get("warc-date"), http.decode("utf-8", "replace"), body))
                if found:
                    date, http, body = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(date, pa.string()), pa.array(http, pa.string()), pa.array(body, pa.binary())], names=[*part.schema.names, "date", "headers", "body"])
        if f is not None:
            f.close()

    dealt = rows.withColumn("stretch", F.floor(F.col("offset") / SPREAD)).repartition("path", "stretch").sortWithinPartitions("path", "offset").drop("stretch")
    return dealt.mapInArrow(read, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, date string, headers string, body binary")

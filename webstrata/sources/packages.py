"""Archive packages: a tar file for each archive (WACZ packages: ``wacz``).

A package is one file, so one task writes it, entry by entry, from rows sorted by archive and place; nothing but the entry at hand is held in memory. Files
get a name of their own and only those of tasks that ended are listed.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir
from .warc import _store, files_of


class TarPackage:
    """USTAR entries on a binary stream."""

    ending = ".tar"

    def __init__(self, stream):
        self.tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.USTAR_FORMAT)

    def add(self, name: str, data: bytes) -> None:
        entry = tarfile.TarInfo(name)
        entry.size = len(data)
        self.tar.addfile(entry, io.BytesIO(data))

    def close(self) -> None:
        self.tar.close()


def write_packages(files: DataFrame, kind: type = TarPackage, folder: str | None = None) -> DataFrame:
    """Write files (archive_id, place, name, content) to a package for each archive; returns (archive_id, path, entries). Entries keep the order of ``place``."""
    folder = folder or shared_dir(files.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        now, package, stream, path, n, done = None, None, None, "", 0, []

        def finish() -> None:
            if package is not None:
                package.close()
                stream.close()
                done.append((now, f"{folder}/{path}", n))

        for batch in batches:
            for archive, name, content in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if package is None or archive != now:
                    finish()
                    now, n, path = archive, 0, f"{archive}-{uuid.uuid4().hex}{kind.ending}"
                    stream = store.open_output_stream(f"{at}/{path}", compression=None)
                    package = kind(stream)
                package.add(name, content or b"")
                n += 1
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive_id", "path", "entries"])

    rows = files.select(F.col("archive_id").cast("long"), "name", "content", "place").repartition("archive_id").sortWithinPartitions("archive_id", "place", "name").drop("place")
    return cut(rows.mapInArrow(write, "archive_id long, path string, entries long"))


def read_tars(packages: DataFrame) -> DataFrame:
    """(archive_id, place, name, content) of tar packages (archive_id, path), entry by entry. Names that leave the archive, and broken headers, raise an error."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _store(path)
                with store.open_input_stream(at, compression=None) as f, tarfile.open(fileobj=f, mode="r|") as tar:
                    for place, entry in enumerate(tar):
                        if entry.name.startswith("/") or ".." in entry.name.split("/") or "\\" in entry.name:
                            raise ValueError(f"unsafe name {entry.name!r}")
                        if entry.isfile():
                            yield pa.RecordBatch.from_pydict({"archive_id": [archive], "place": [place], "name": [entry.name], "content": [tar.extractfile(entry).read()]})

    return packages.select("archive_id", "path").repartition("path").mapInArrow(read, "archive_id long, place long, name string, content binary")


def listed(spark: SparkSession, folder: str, ending: str = ".tar") -> DataFrame:
    """(archive_id, path) of the packages in a folder; the archive is the number their name begins with."""
    rows = spark.createDataFrame([(p,) for p in files_of(folder, (ending,))], "path string")
    return rows.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(\d+)-", 1).cast("long").alias("archive_id"), "path")

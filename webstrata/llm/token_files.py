"""Token files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file is a run of frames in ascending doc_id order, then one skippable frame with the document index, then one with the seek
table (the public seekable format: compressed size, size and low 32 bits of XXH64 of each frame). A frame holds the ids of whole
documents, little-endian unsigned 32-bit, about ``frame_bytes`` of them. A reader decompresses the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shared_dir, whole_text

# fixed values of the public seekable zstandard format
SEEK_FRAME, INDEX_FRAME, SEEK_FOOTER, CHECKSUM_FLAG = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80


class TokenFile:
    """Writes one file to a binary stream, a frame as soon as it is full; only the index of documents and frames is held."""

    def __init__(self, out, frame_bytes: int, level: int = 1):
        import zstandard

        self.out, self.compressor, self.frame_bytes = out, zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames, self.open, self.docs, self.tokens = [], bytearray(), [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.open and len(self.open) + len(ids) > self.frame_bytes:
            self._close()
        self.docs.append((-1 if doc_id is None else doc_id, doc_id is not None, len(self.frames), len(self.open), len(ids) // 4))
        self.open += ids
        self.tokens += len(ids) // 4

    def _close(self) -> None:
        import xxhash

        packed = self.compressor.compress(bytes(self.open))
        self.frames.append((len(packed), len(self.open), xxhash.xxh64_intdigest(self.open) & 0xFFFFFFFF))
        self.out.write(packed)
        self.open = bytearray()

    def finish(self) -> None:
        if self.open:
            self._close()
        index = self.compressor.compress(np.array(self.docs, INDEX_TYPE).tobytes())
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_FOOTER)
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index + struct.pack("<II", SEEK_FRAME, len(seek)) + seek)


INDEX_TYPE = np.dtype([("doc_id", "<i8"), ("known", "?"), ("frame", "<u4"), ("offset", "<u4"), ("n", "<u4")])


def read_token_file(data, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in this file, ids) of the documents asked for, or of all. ``data``: a seekable binary file.

    Raises ValueError if a decompressed frame doesn't have its checksum.
    """
    import xxhash
    import zstandard

    unpack, end = zstandard.ZstdDecompressor(), data.seek(0, 2)
    data.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", data.read(9))
    if magic != SEEK_FOOTER:
        raise ValueError("no seek table")
    data.seek(end - 9 - 12 * n)
    frames = np.frombuffer(data.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(frames[:, 0])])
    data.seek(int(starts[-1]))
    _, size = struct.unpack("<II", data.read(8))
    index = np.frombuffer(unpack.decompress(data.read(size)), INDEX_TYPE)
    before = np.concatenate([[0], np.cumsum(index["n"].astype(np.int64))])
    current, raw = -1, b""
    for i, (doc_id, known, frame, offset, count) in enumerate(index.tolist()):
        if wanted is not None and doc_id not in wanted:
            continue
        if count and frame != current:
            data.seek(int(starts[frame]))
            raw, current = unpack.decompress(data.read(int(frames[frame, 0])), max_output_size=int(frames[frame, 1])), frame
            if len(raw) != frames[frame, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != frames[frame, 2]:
                raise ValueError(f"frame {frame} is damaged")
        yield doc_id if known else None, int(before[i]), np.frombuffer(raw, "<u4", count, offset)


def _store(path: str):
    """The folder's file system; local, HDFS or an object store, as the executors reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", frame_bytes: int = 1 << 18, file_text: int = 64 << 20) -> DataFrame:
    """Write the ids of all rows of ``df`` in ascending doc_id order and return the files: file_no, path, n_docs, n_tokens, start.

    ``tokenizer``: file of the tokenizers library. Each document gets ``end_id`` appended; a null text is empty, null ids come first,
    repeated rows are written each. ``start``: ids in all files before. A task writes one file, of about ``file_text`` bytes of text, under a name of its
    own, and only the files of tasks that ended are listed, so a lost executor leaves no wrong rows.
    """
    spark, folder = df.sparkSession, folder or shared_dir(df.sparkSession)
    end = struct.pack("<I", end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .fast_tokens import tokens_of

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder, part = tokens_of(tokenizer), TaskContext.get().partitionId()
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        with store.open_output_stream(f"{at}/{name}", compression=None) as stream:
            out = TokenFile(stream, frame_bytes)
            for batch in chain([first], batches):
                for key, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist()), strict=True):
                    out.add(key, ids + end)
            out.finish()
        yield pa.RecordBatch.from_pydict({"file_no": [part], "path": [f"{folder}/{name}"], "n_docs": [len(out.docs)], "n_tokens": [out.tokens]})

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), whole_text(df[text]).alias("text"))
    ordered = ["doc_id", F.xxhash64("text")]  # rows that share an id, or have none, needn't share a file
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_text))
    files = materialize(rows.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered).mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long"))
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, files: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit) from the files, one task for some files each."""
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                store, at = _store(path)
                rows = []
                with store.open_input_file(at) as f:
                    for key, before, ids in read_token_file(f, wanted):
                        rows.append((key, start + before, len(ids), ids.tobytes()))
                        if len(rows) == 500:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    n = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.select("path", "start").repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    return out.astype({"doc_id": "Int64"})

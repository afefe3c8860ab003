"""Token ids in seekable binary files.

A file is a row of independent zstandard frames and a trailing seek table in
the published seekable layout: a skippable frame with the compressed size, raw
size and checksum (lower 32 bits of XXH64 of the raw bytes) of every frame, the
frame count, a descriptor and the magic number. The data frames hold
little-endian uint32 ids, cut only between documents. The frame before the
seek table lists the documents (id, first id's place, number of ids, data
frame), so a reader decompresses just the frames of the documents it wants.

A file is closed at `FILE_BYTES` of ids or `FILE_DOCUMENTS` documents, whichever
comes first, so that neither a list of documents nor a seek table grows with the
table; a frame holds `FRAME_BYTES` or one document.

Defined results: a null text counts as empty and gives the end id alone; a text of
any length is encoded whole, into one frame; rows with a null doc_id come first;
repeated doc_ids each keep their row, in unspecified order among themselves, and
may lie in several files; an empty table gives no documents. Extra columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palimpsest.llm.common import shared_path
from palimpsest.llm.tokens import encoder, release_memory

SKIPPABLE_MAGIC, SEEKABLE_MAGIC, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 20
#: Limits of a file.
FILE_BYTES = 256 << 20
FILE_DOCUMENTS = 1 << 20
#: A task gets about so many bytes of the input, as its plan estimates them.
TASK_BYTES = 128 << 20
LEVEL = 1
END_ID = 2
#: doc_id (with a flag for null), place of the first id, number of ids, data frame.
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "<u4"), ("frame", "<u4"), ("start", "<i8"), ("n", "<i8")])


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes documents to an open binary stream."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.listed: list[np.ndarray] = []
        self.recent: list[tuple] = []
        self.parts: list[bytes] = []
        self.held = self.ids = self.documents = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.recent.append((doc_id or 0, doc_id is not None, len(self.frames), self.ids, n))
        if len(self.recent) == 4096:
            self._pack()
        self.documents += 1
        self.ids += n
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_bytes:
            self.flush()

    def _pack(self) -> None:
        self.listed.append(np.array(self.recent, DOCUMENT))
        self.recent = []

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.parts:
            self._frame(b"".join(self.parts))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        self._pack()
        self._frame(np.concatenate(self.listed).tobytes())
        entries = b"".join(struct.pack("<III", *frame) for frame in self.frames)
        size = len(entries) + 9
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, size) + entries)
        self.stream.write(struct.pack("<IBI", len(self.frames), HAS_CHECKSUM, SEEKABLE_MAGIC))


class FrameReader:
    """Reads documents from a seekable binary file."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUM:
            raise ValueError("not a seekable token file")
        file.seek(size - 9 - 12 * count)
        table = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = table.T
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.documents = np.frombuffer(self.frame(count - 1), DOCUMENT)
        #: Place of each data frame's first id.
        self.firsts = np.concatenate(([0], np.cumsum(self.raw[:-1] // 4)))

    def frame(self, number: int) -> bytes:
        self.file.seek(int(self.offsets[number]))
        packed = self.file.read(int(self.sizes[number]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.raw[number])))
        if len(raw) != self.raw[number] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[number]:
            raise ValueError(f"checksum of frame {number} does not match")
        return raw

    def read(self, rows: Sequence[int] | None = None) -> Iterator[tuple[np.void, bytes]]:
        """The entries and ids of the documents at `rows` (all by default)."""
        have, raw = -1, b""
        for i in range(len(self.documents)) if rows is None else rows:
            d = self.documents[i]
            if d["frame"] != have:
                have, raw = int(d["frame"]), self.frame(int(d["frame"]))
            at = int(d["start"] - self.firsts[have]) * 4
            yield d, raw[at : at + 4 * int(d["n"])]


def tasks_for(docs: DataFrame) -> int:
    """Tasks of about `TASK_BYTES` of input each, by the plan's own estimate, and no fewer than shuffles have."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Frames that aren't read from files have no estimate but a placeholder beyond any size.
    return least if size >= 1 << 60 else max(least, -(-size // TASK_BYTES))


def write(
    docs: DataFrame, path: str, vocabulary: str, text: str = "text", end_id: int = END_ID, partitions: int | None = None,
    file_bytes: int = FILE_BYTES, file_documents: int = FILE_DOCUMENTS,
) -> list[tuple[int, int, str, int, int]]:
    """Writes the ids of all documents under `path`, in ascending doc_id order.

    Documents are dealt out in ranges of doc_id, rows of one doc_id by a hash too, so
    that an id with very many rows spans ranges. Each task streams its range to
    files, one after the other; memory holds one frame and a file's list of
    documents. Every attempt of a task writes files of names of its own, and only the
    manifest says which count, so attempts that are lost or repeated do no harm.
    Returns the manifest: (range, number, file, documents, ids) for each file; only
    that travels to the driver, one row for `file_bytes` of ids or `file_documents`.
    """
    n = partitions or tasks_for(docs)
    spread = F.xxhash64(F.monotonically_increasing_id()).alias("spread")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), spread)
    ranged = rows.repartitionByRange(n, "doc_id", "spread").sortWithinPartitions("doc_id", "spread").select("doc_id", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        filesystem, folder = _filesystem(path)
        words, end = encoder(vocabulary), struct.pack("<I", end_id)
        rows = ((d, ids) for b in batches for d, ids in zip(b.column("doc_id").to_pylist(), words.encode_all(b.column("text"))))
        number, row, attempt = 0, next(rows, None), uuid.uuid4().hex
        while row is not None:
            file = f"{folder}/part-{task:06d}-{number:06d}-{attempt}.tok"
            with filesystem.open_output_stream(file) as stream:
                writer = FrameWriter(stream)
                while row is not None and 4 * writer.ids < file_bytes and writer.documents < file_documents:
                    writer.add(row[0], row[1] + end)
                    row = next(rows, None)
                writer.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "file": [file],
                    "docs": [writer.documents], "ids": [writer.ids],
                }
            )
            number += 1
        release_memory()

    _filesystem(path)[0].create_dir(_filesystem(path)[1], recursive=True)
    made = ranged.mapInArrow(store, "part int, number int, file string, docs bigint, ids bigint").collect()
    return sorted((r.part, r.number, r.file, r.docs, r.ids) for r in made)


_READ = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))]
)


def read_back(spark: SparkSession, path: str, manifest: list[tuple[int, int, str, int, int]]) -> DataFrame:
    """Per document: place of its first id among all ids, number of ids and their CRC-32.

    One row per file goes out to the tasks, with the ids in all files before it.
    """
    starts, total = [], 0
    for _, _, file, _, ids in manifest:
        starts.append((file, total))
        total += ids
    files = spark.createDataFrame(starts, "file string, before bigint").repartition(max(1, len(starts)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, before in zip(batch["file"], batch["before"]):
                filesystem, _ = _filesystem(path)
                with filesystem.open_input_file(file) as source:
                    reader = FrameReader(source, source.size())
                    d = reader.documents
                    crcs = [zlib.crc32(ids) for _, ids in reader.read()]
                ids = pd.array(d["doc_id"].astype("int64"), dtype="Int64")
                ids[d["known"] == 0] = pd.NA
                yield pd.DataFrame(
                    {"doc_id": ids, "start": d["start"].astype("int64") + before, "n_tokens": d["n"].astype("int64"), "ids_crc32": crcs}
                )

    return files.mapInPandas(read, _READ)


def encode_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    return read_back(spark, path, write(docs, path, vocabulary))

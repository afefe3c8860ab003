"""Packing token sequences into fixed windows, online and in bounded space.

Each task keeps a fixed number of open windows. A piece goes to the open window
that it fills best. When none has room for it, the fullest window takes just
what still fits, which completes it, and is emitted; the rest of the piece is
placed again. So no emitted window has padding, and documents are cut only
where no window fits. The windows left open are merged in rounds over ever
fewer tasks in the same way; the very last are cut at powers of two, which
need no padding.

Defined results: a null text counts as empty and gives the end id alone; a text of
any length is encoded whole and cut; of open windows that a piece fills equally
well the one opened first takes it; an empty table gives no pieces; repeated or null
doc_ids are separate documents; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.common import saved
from palimpsest.llm.tokens import CACHE_ENTRIES, CHUNK_BYTES, encoder, release_memory

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Complete windows that a task holds before it passes them on.
HELD_WINDOWS = 512
#: Left-over windows that one task of a merge round takes.
FAN_IN = 2048

_PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, left_over binary"
)
_COLUMNS = [x.split()[0] for x in _PIECES.split(", ")]
ROUND_BITS, TASK_BITS = 56, 32


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) into windows of `size` ids.

    The open windows are ordered by their room, so best fit is one bisection.
    `emit` gets each complete window.
    """

    def __init__(self, size: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.size, self.limit = size, open_windows
        self.rooms: list[tuple[int, int]] = []
        self.open: dict[int, list] = {}
        self.made = 0
        self.full: list[list] = []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        whole = self.size * 4
        while len(ids) >= whole:
            self.full.append([(doc_id, start, ids[:whole], doc_tokens)])
            ids, start = ids[whole:], start + self.size
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, key = self.rooms.pop(at)
                self.open[key].append((doc_id, start, ids, doc_tokens))
                if room == n:
                    self.full.append(self.open.pop(key))
                else:
                    insort(self.rooms, (room - n, key))
                return
            if len(self.rooms) < self.limit:
                self.open[self.made] = [(doc_id, start, ids, doc_tokens)]
                insort(self.rooms, (self.size - n, self.made))
                self.made += 1
                return
            room, key = self.rooms.pop(0)  # the fullest; the piece is longer than its room
            self.full.append([*self.open.pop(key), (doc_id, start, ids[: 4 * room], doc_tokens)])
            ids, start = ids[4 * room :], start + room

    def close(self) -> Iterator[list]:
        """The windows that are still open, fullest first."""
        for _, key in self.rooms:
            yield self.open.pop(key)
        self.rooms = []


def powers_of_two(pieces: list, size: int) -> Iterator[list]:
    """Cuts a window's pieces into windows whose lengths are powers of two."""
    left = sum(len(p[2]) for p in pieces) // 4
    while left:
        take = 1 << (min(left, size).bit_length() - 1)
        window, got = [], 0
        while got < take:
            doc_id, start, ids, total = pieces[0]
            n = min(len(ids) // 4, take - got)
            window.append((doc_id, start, ids[: 4 * n], total))
            pieces = ([(doc_id, start + n, ids[4 * n :], total)] if 4 * n < len(ids) else []) + pieces[1:]
            got += n
        left -= take
        yield window


def _rows(windows: Iterator[list], first_id: int, left_over: bool) -> list[tuple]:
    out = []
    for k, window in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), total, first_id + k, offset, ids if left_over else None))
            offset += n
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_COLUMNS)
    kinds = [pa.binary() if c == "left_over" else pa.int64() for c in _COLUMNS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _COLUMNS)


def _task(round_: int) -> int:
    from pyspark import TaskContext

    return (round_ << ROUND_BITS) | (TaskContext.get().partitionId() << TASK_BITS)


def pack(
    docs: DataFrame, vocabulary: str, text: str = "text", size: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, fan_in: int = FAN_IN,
    cache_entries: int = CACHE_ENTRIES, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Packs the ids of all documents; one row per piece.

    Only pieces' places and checksums leave the tasks, but for the ids of the
    windows left open: at most `open_windows` times `size` ids a task. A merge
    task takes `fan_in` left-over windows; that must be at least twice
    `open_windows`, or rounds need not get smaller. The encoder's cache and chunks
    trade time for memory; they never change a result.
    """
    if fan_in < 2 * open_windows:
        raise ValueError("fan_in must be at least twice open_windows")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    end = struct.pack("<I", end_id)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words, base, done = Packer(size, open_windows), encoder(vocabulary, cache_entries, chunk_bytes), _task(0), 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode_all(batch.column("text"))):
                ids += end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(packer.full) >= HELD_WINDOWS:
                    yield _arrow(_rows(packer.full, base + done, False))
                    done += len(packer.full)
                    packer.full = []
        yield _arrow(_rows(packer.full, base + done, False))
        yield _arrow(_rows(packer.close(), base + done + len(packer.full), True))
        release_memory()

    placed = saved(rows.mapInArrow(first, _PIECES), "packed")
    parts = [placed.where("left_over IS NULL")]
    left, round_ = placed.where("left_over IS NOT NULL"), 1
    while True:
        windows = left.agg(F.count_if(F.col("offset") == 0)).first()[0]
        if not windows:
            break
        tasks = -(-windows // fan_in)
        last = tasks == 1

        def merge(batches: Iterator[pd.DataFrame], round_=round_, last=last) -> Iterator[pd.DataFrame]:
            packer, base, done = Packer(size, open_windows), _task(round_), 0
            for batch in batches:
                columns = (batch[c] for c in ("doc_id", "start", "left_over", "doc_tokens"))
                for doc_id, start, ids, total in zip(*columns):
                    packer.add(None if pd.isna(doc_id) else int(doc_id), int(start), bytes(ids), int(total))
                yield _frame(_rows(packer.full, base + done, False))
                done += len(packer.full)
                packer.full = []
            held = list(packer.close())
            if last:
                # Fill windows up one after the other; only the very last stays partly filled.
                held = [p for w in held for p in w]
                held = list(powers_of_two(held, size)) if held else []
            yield _frame(_rows(held, base + done, not last))

        spread = left.repartitionByRange(tasks, "sequence_id", "offset").sortWithinPartitions("sequence_id", "offset")
        merged = saved(spread.mapInPandas(merge, _PIECES), "packed")
        parts.append(merged.where("left_over IS NULL"))
        if last:
            break
        left, round_ = merged.where("left_over IS NOT NULL"), round_ + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("left_over")

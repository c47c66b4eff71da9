"""Sum-of-squares online packing of documents into training windows.

A window's level is the number of its places that are filled. A piece goes to the level (an empty window is level 0) that
makes the sum of squared counts of partially filled windows smallest; the counts are kept in an array by level. Each
task packs the documents of its own partition, so nothing is shuffled and memory holds one partition's open windows,
at most a few for each level. When a partition ends, windows that are still open keep what they hold, the fullest first, and
are filled up with pieces cut from the emptiest ones; what is left of the last becomes one window for each power of two in its
size, which needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from locuspark.llm.common import as_bytes
from locuspark.llm.token_counts import encoder

WINDOW = 2048
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


class Packer:
    """Pieces (document, start, length) of one partition to windows; ready windows are handed out as they fill."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # open windows at each level; level 0 and full ones count as none
        self.open: dict[int, list[list]] = {}
        self.next_id = 0

    def place(self, size: int) -> int:
        """The level whose window takes a piece of this size: 0 for a new one."""
        count, room = self.count, self.window - size
        # growing a window from level h to h + size changes the sum by 2 (N(h + size) - N(h)) + 2; a full one leaves it
        after = count[size : size + room + 1]
        change = 2 * (after - count[: room + 1]) + 2
        change[room] = 1 - 2 * count[room] if room else 0
        change[0] = 2 * count[size] + 1 if room else 0
        change[1:][count[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return int(change[::-1].argmin() * -1 + room)  # among equals the fullest

    def add(self, piece: tuple) -> list | None:
        """Place a piece; returns the window that it fills, if it does."""
        size = piece[2]
        level = self.place(size)
        if level:
            self.count[level] -= 1
            pieces = self.open[level].pop()
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == self.window:
            return pieces
        self.count[level] += 1
        self.open.setdefault(level, []).append(pieces)
        return None

    def rest(self) -> Iterator[list]:
        """The open windows, filled up by pieces cut from the emptiest of them; last, windows of powers of two."""
        windows = [(level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        self.open, self.count[:] = {}, 0
        while windows:
            level, pieces = windows.pop(0) if len(windows) > 1 else (0, [])
            sizes = [self.window - level]
            if not pieces:  # the last window: its binary digits, the largest first
                level = windows[0][0]
                sizes = [1 << k for k in range(level.bit_length() - 1, -1, -1) if level >> k & 1]
            for size in sizes:
                pieces = [*pieces, *self._take(windows, size)]
                size = sum(p[2] for p in pieces)
                if size & (size - 1):  # nothing is left to fill it with
                    windows.append((size, pieces))
                else:
                    yield pieces
                pieces = []

    @staticmethod
    def _take(windows: list[tuple[int, list]], size: int) -> list[tuple]:
        """Up to ``size`` places' worth of pieces from the ends of the last windows, which lose them."""
        out = []
        while size and windows:
            level, pieces = windows[-1]
            doc, start, length = pieces[-1]
            take = min(size, length)
            out.append((doc, start + length - take, take))
            size, level = size - take, level - take
            if take == length:
                pieces.pop()
            else:
                pieces[-1] = (doc, start, length - take)
            if pieces:
                windows[-1] = (level, pieces)
            else:
                windows.pop()
        return out


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pack all rows of docs (doc_id, text; other columns take no part) into windows of at most ``window`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is false,
    the ids. A null or empty text is the end id alone. Repeated rows and null ids are documents of their own. An empty
    table gives no piece. A document longer than a window fills windows of its own first; what remains is one piece,
    placed by the sum of squares and cut again only if it lies in one of the emptiest windows at a partition's end. sequence_id holds the partition in its upper bits.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, packer, doc_ids, held = encoder(path), Packer(window), [], {}
        base, serial = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []

        def emit(pieces: list) -> None:
            nonlocal serial
            at = 0
            for doc, start, length in pieces:
                ids, left = held[doc][0], held[doc][1] - length
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_ids[doc], start, length, zlib.crc32(part), len(ids) // 4, base | serial, at, part))
                at += length
                if left:
                    held[doc] = (ids, left)
                else:
                    del held[doc]
            serial += 1

        def flush() -> pa.RecordBatch:
            doc, start, length, crc, total, seq, at, parts = zip(*rows)
            columns = [pa.array(doc, kind_arrow), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, seq, at))]
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        kind_arrow = None
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
        for batch in batches:
            kind_arrow = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), e.values(as_bytes(batch.column(1)))):
                doc, ids = len(doc_ids), ids + end
                n = len(ids) // 4
                doc_ids.append(doc_id)
                held[doc] = (ids, n)
                whole = n - n % window
                for start in range(0, whole, window):
                    emit([(doc, start, window)])
                if n > whole and (full := packer.add((doc, whole, n - whole))):
                    emit(full)
                if len(rows) >= 4096:
                    yield flush()
        for pieces in packer.rest():
            emit(pieces)
        if rows:
            yield flush()

    return docs.mapInArrow(run, f"doc_id {kind}, " + SCHEMA if with_ids else f"doc_id {kind}, " + SCHEMA.rpartition(",")[0])

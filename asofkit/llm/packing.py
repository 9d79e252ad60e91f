"""Sum-of-squares online packing of token streams into windows of a fixed length.

Each task packs the documents of its input split as they come. A document fills whole windows first; the rest goes into
the open window whose choice keeps the sum of squared counts of open windows by fill level lowest, the counts lying in
a level array. Windows still open at the end are cut and joined to full ones; what remains is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import columns, slices_by_bytes, small_batches
from .tokens import encoder

#: A piece: document row, first id within it, its ids, ids of the whole document.
Piece = tuple[object, int, np.ndarray, int]


class Packer:
    """Packs pieces; closed windows leave through `closed` as lists of pieces.

    max_open bounds the open windows, so memory is max_open * window ids: beyond it, all open windows are cut and
    joined, which only spares padding later.
    """

    def __init__(self, window: int, max_open: int = 1024) -> None:
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)  # open windows by fill level
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.closed: list[list[Piece]] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.closed.append([(doc, at, ids[at : at + self.window], total)])
            at += self.window
        if at < total:
            self._place((doc, at, ids[at:], total))

    def _place(self, piece: Piece) -> None:
        n, counts, w = len(piece[2]), self.counts, self.window
        # Change of the sum of squares when a window of level h goes to level h + n.
        levels = np.flatnonzero(counts[1 : w - n + 1]) + 1
        if len(levels):
            change = 1 - 2 * counts[levels] + np.where(levels + n == w, 0, 2 * counts[levels + n] + 1)
            best = len(levels) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
        if not len(levels) or change[best] > 2 * counts[n] + 1:
            level, pieces = 0, []
        else:
            level = int(levels[best])
            counts[level] -= 1
            pieces = self.open[level].pop()
        pieces.append(piece)
        if level + n == w:
            self.closed.append(pieces)
            return
        counts[level + n] += 1
        self.open[level + n].append(pieces)
        if counts.sum() > self.max_open:
            self._join(last=False)

    def _join(self, last: bool) -> None:
        """Cut the pieces of all open windows to full windows; the rest stays open or is cut at powers of two."""
        pieces = [p for level in range(self.window, 0, -1) for window in self.open[level] for p in window]
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        left = sum(len(p[2]) for p in pieces)
        now, room = [], min(self.window, left)
        for doc, start, ids, total in pieces:
            while len(ids):
                if last and not now:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = ids[:room]
                now.append((doc, start, take, total))
                start, ids, room, left = start + len(take), ids[len(take) :], room - len(take), left - len(take)
                if not room:
                    self.closed.append(now)
                    now, room = [], self.window
        if now:
            fill = sum(len(p[2]) for p in now)
            if last:
                self.closed.append(now)
            else:
                self.counts[fill] = 1
                self.open[fill] = [now]

    def finish(self) -> None:
        self._join(last=True)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, spaces: str = "dropped", key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (within its sequence, gapless from 0), and the raw ids if asked for.

    Every id of every document (its text's and the end id) lies in exactly one piece. A null text is empty and gives
    the end id alone; null keys and repeated rows are packed like others; an empty table gives no rows; other columns
    play no part. Sequence ids are unique, not consecutive: the task's number and a counter. Each task packs
    what it reads, so which pieces share a sequence follows the input's partitions; that every id lies in one piece, and
    the pieces' contents, do not.
    """
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, number = encoder(tokenizer, spaces), Packer(window), TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)

        def leave() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for pieces in packer.closed:
                at = 0
                for doc, start, ids, total in pieces:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, at, *([raw] if with_ids else [])))
                    at += len(ids)
                number += 1
            packer.closed = []
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)]
                yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

        for batch in batches:
            for a, b in slices_by_bytes(batch.column(1), 4 << 20):
                ids, start = coder.encode(batch.column(1).slice(a, b - a))
                for doc, x, y in zip(batch.column(0).slice(a, b - a).to_pylist(), start[:-1], start[1:], strict=True):
                    packer.add(doc, np.concatenate([ids[x:y], end]))
                yield from leave()
        packer.finish()
        yield from leave()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = ", ".join(f"{n} long" for n in names[:-1]) + (", ids binary" if with_ids else "")
    return columns(docs, k=key, t=text).selectExpr("cast(k as long) k", "cast(t as string) t").mapInArrow(pack, schema)

"""Operator 9: packing token sequences with the sum-of-squares rule.

Each task reads its part of the documents in order, encodes them and packs the pieces online: a piece goes where it
leaves the smallest sum of squared counts of partially filled windows, counted in an array by fill level. It may go whole
into a window with room or into a new one; or it may be cut, to fill a window exactly while the rest is placed by the
same rule, at a price of `cut_price` squares, so documents stay whole where the levels are balanced. The price also bounds
what is open: a level that holds many windows makes cuts cheaper than one more. Nothing is shuffled, and no task sees
another's documents.

When a task ends, cuts are free and no window is opened while another is: the emptiest window is taken apart and its
pieces are placed by the same rule, until one is left; so a task leaves one window short at most.

Defined results: a null text is empty and yields just the end id; documents longer than a window fill whole
windows first; repeated rows are packed as often as they occur; an empty table gives no pieces; extra columns
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import ChunkIds, worker

#: Ids of a piece are kept as bytes, four for each.
W = 4


_NEVER = 1 << 60


class SumOfSquares:
    """Windows of one task. A piece is (key, start, ids, document's tokens); add() and finish() yield closed windows."""

    def __init__(self, capacity: int, cut_price: int = 8):
        self.capacity, self.price = capacity, cut_price
        self.level = np.zeros(capacity + 1, np.int64)  # partially filled windows by fill level
        self.more = np.ones(capacity + 1, np.int64)  # 2 * level + 1: what one more there adds to the sum
        self.more[capacity] = 0
        self.less = np.full(capacity, _NEVER)  # 1 - 2 * level: what one fewer there adds; none where there is no window
        self.less[0] = 0  # a new window
        self.windows: dict[int, list[list]] = defaultdict(list)

    def _set(self, at: int, change: int) -> None:
        if 0 < at < self.capacity:
            n = self.level[at] = self.level[at] + change
            self.more[at], self.less[at] = 2 * n + 1, 1 - 2 * n if n else _NEVER

    def choose(self, size: int, price: int, least: int = 0) -> int:
        """The fill level (0: a new window; `least` 1: none) whose use leaves the smallest sum of squares.

        A piece with more ids than the level has room is cut. On a tie whole comes before cut, and fuller before emptier.
        """
        first = self.capacity - size + 1  # from this level on the piece is cut
        cost = self.less + np.concatenate([self.more[size:], self.more[1:size] + price])
        cost[:least] = _NEVER
        whole, cut = cost[least:first][::-1], cost[first:][::-1]
        best = self.capacity - size - int(whole.argmin()) if len(whole) else 0
        if not len(whole) or (len(cut) and cut.min() < cost[best]):
            return self.capacity - 1 - int(cut.argmin())
        return best

    def _place(self, key: object, start: int, ids: bytes, tokens: int, price: int, least: int = 0) -> Iterator[list]:
        while ids:
            at = self.choose(len(ids) // W, price, least if self.windows else 0)
            window = []
            if at:
                window = self.windows[at].pop()
                if not self.windows[at]:
                    del self.windows[at]
            self._set(at, -1)
            part, ids = ids[: (self.capacity - at) * W], ids[(self.capacity - at) * W :]
            window.append((key, start, part, tokens))
            n = len(part) // W
            start += n
            if at + n == self.capacity:
                yield window
            else:
                self.windows[at + n].append(window)
                self._set(at + n, 1)

    def add(self, key: object, ids: bytes) -> Iterator[list]:
        tokens, start = len(ids) // W, 0
        while tokens - start >= self.capacity:
            yield [(key, start, ids[start * W : (start + self.capacity) * W], tokens)]
            start += self.capacity
        yield from self._place(key, start, ids[start * W :], tokens, self.price)

    def finish(self) -> Iterator[list]:
        while sum(map(len, self.windows.values())) > 1:
            at = min(self.windows)
            pieces = self.windows[at].pop()
            if not self.windows[at]:
                del self.windows[at]
            self._set(at, -1)
            for piece in pieces:
                yield from self._place(*piece, price=0, least=1)
        for at in [*self.windows]:
            yield from self.windows.pop(at)
            self._set(at, -1)


def pack(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32).

    sequence_id joins the task's number and the window's number within it; offsets are gapless from 0.
    """
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = src.schema["key"].dataType
    names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, windows = worker(ChunkIds, path), SumOfSquares(capacity)
        task = TaskContext.get()
        number, last, rows = (task.partitionId() if task else 0) << 36, end_id.to_bytes(W, "little"), []
        types = [None, *[pa.int64()] * 5, pa.binary()]

        def closed(some: Iterator[list]) -> None:
            nonlocal number
            for window in some:
                at = 0
                for k, start, ids, tokens in window:
                    rows.append((k, start, len(ids) // W, tokens, number, at, ids))
                    at += len(ids) // W
                number += 1

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return made

        for whole in batches:
            types[0] = whole.schema.field("key").type
            for batch in slices(whole):
                for k, ids in zip(batch.column("key").to_pylist(), table.of(batch.column("text").to_pylist())):
                    closed(windows.add(k, ids + last))
                if rows:
                    yield out()
        closed(windows.finish())
        if rows:
            yield out()

    return src.mapInArrow(packed, f"key {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("key", key)

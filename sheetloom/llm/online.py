"""Sum-of-squares online packing of token sequences.

A task takes its documents one after the other.  It keeps a level array: how many
windows are filled to each level.  A document goes into the level that leaves the
smallest sum of squared counts of partially filled windows, an empty window being
one of the choices; that keeps levels mixed, so that most documents find a window
they fill.  Documents of a window or more give off whole windows first.

Windows that are still open at the end of a task, or beyond ``OPEN`` of them, are
drained: the emptiest ones are cut to fill the fullest.  What is left of a task is
cut into windows whose lengths are powers of two, which need no padding.  A task
holds open windows alone and needs no other task's: nothing is shuffled, and a
task that is run again gives the same windows.

Null or empty text: the end id alone.  Repeated rows are packed as often as they
come; a null key stays null.  An empty table packs to none.  Only the named columns
are read, so further columns can have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetloom.functions.exprs import ident
from sheetloom.llm.base import picked, ready, table
from sheetloom.llm.tokens import encoder, vocabulary

CAPACITY = 2048
#: Open windows a task holds; beyond them half are drained.
OPEN = 4096
#: Windows a task can number.
_WINDOWS = 1 << 36

#: A stretch of a document: its number of tokens before it, its ids, the document's key and tokens.
Piece = tuple[int, np.ndarray, object, int]


class Windows:
    """Windows of ``capacity`` tokens that are filled online; complete ones leave through ``done``."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        #: Number of windows at each level; empty and full ones are not counted.
        self.counts = np.zeros(capacity + 1, np.int64)
        self.at_level: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.done: list[list[Piece]] = []

    def level_for(self, n: int) -> int:
        """The level, 0 for an empty window, whose choice leaves the smallest sum of squares; the fullest of equals."""
        last = self.capacity - n
        change = self.counts[n:] - self.counts[:last + 1]
        # (x + 1)^2 - x^2 for the level that gains a window, (x - 1)^2 - x^2 for the one that loses it
        change = 2 * change + 2
        change[0] -= 1
        change[last] -= 1
        change[1:][self.counts[1:last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def put(self, level: int, window: list[Piece], n: int) -> None:
        """Keeps a window that came from ``level`` and has ``n`` tokens more."""
        level += n
        if level == self.capacity:
            self.done.append(window)
            return
        self.at_level[level].append(window)
        self.counts[level] += 1
        self.open += 1

    def take(self, level: int) -> list[Piece]:
        if level == 0:
            return []
        self.counts[level] -= 1
        self.open -= 1
        return self.at_level[level].pop()

    def add(self, key, ids: np.ndarray) -> None:
        """Packs a document's ids."""
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.done.append([(start, ids[start:start + self.capacity], key, total)])
            start += self.capacity
        n = total - start
        if n:
            level = self.level_for(n)
            window = self.take(level)
            window.append((start, ids[start:].copy(), key, total))  # not a view that holds the whole document
            self.put(level, window, n)
        if self.open > self.limit:
            self.drain(self.limit // 2)

    def drain(self, left: int) -> None:
        """Cuts the emptiest windows to fill the fullest until at most ``left`` are open."""
        while self.open > max(left, 1):
            levels = np.flatnonzero(self.counts)
            source = self.take(int(levels[0]))
            have = int(levels[0])
            while have and self.open:
                level = int(np.flatnonzero(self.counts)[-1])
                target = self.take(level)
                room = self.capacity - level
                moved = 0
                while source and moved < room:
                    start, ids, key, total = source.pop()
                    n = min(len(ids), room - moved)
                    if n < len(ids):
                        source.append((start + n, ids[n:], key, total))
                    target.append((start, ids[:n], key, total))
                    moved += n
                have -= moved
                self.put(level, target, moved)
            if have:
                self.put(have, source, 0)

    def finish(self) -> None:
        """Drains all windows; the rest is cut into windows of powers of two."""
        self.drain(1)
        if not self.open:
            return
        level = int(np.flatnonzero(self.counts)[-1])
        rest = self.take(level)[::-1]
        while level:
            room = 1 << (level.bit_length() - 1)
            level -= room
            window = []
            while room:
                start, ids, key, total = rest.pop()
                n = min(len(ids), room)
                window.append((start, ids[:n], key, total))
                if n < len(ids):
                    rest.append((start + n, ids[n:], key, total))
                room -= n
            self.done.append(window)


PIECES = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType())])


def pack_online(docs: DataFrame, vocab: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id",
                text: str = "text", carry_ids: bool = True, limit: int = OPEN) -> DataFrame:
    """Pieces (key, start, length, ids, ids_crc32, doc_tokens) with ``sequence_id`` and ``offset``.

    ``ids`` are unsigned 32-bit numbers, null without ``carry_ids``.  The result is a narrow step over ``docs``: its
    windows are those of the partitions that ``docs`` has.
    """
    ready(docs.sparkSession)
    schema, path = to_arrow_schema(PIECES), vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.asarray([end_id], np.uint32)
        windows, number = Windows(capacity, limit), TaskContext.get().partitionId() * _WINDOWS

        def flush() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for window in windows.done:
                offset = 0
                for start, ids, name, total in window:
                    raw = ids.astype("<u4").tobytes()
                    rows.append((name, start, len(ids), raw if carry_ids else None, zlib.crc32(raw), total, number, offset))
                    offset += len(ids)
                number += 1
            windows.done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), own.lists(batch.column(1))):
                windows.add(name, np.concatenate((found, end)))
                if len(windows.done) >= 512:
                    yield flush()
        windows.finish()
        if windows.done:
            yield flush()

    return docs.select(F.col(ident(key)).cast("long").alias("key"), F.col(ident(text)).alias("text")).mapInArrow(run, PIECES)


def op12_online_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = pack_online(picked(table(spark, d, "documents"), "doc_id", "text"), "word_bpe_49k.json", 1, carry_ids=False)
    return packed.select(F.col("key").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_online_packing": op12_online_packing}
ORACLES: dict[str, str] = {}

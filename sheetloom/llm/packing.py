"""Pattern packing of token sequences by non-negative least squares.

Documents are cut into pieces of at most ``capacity`` tokens.  Which pieces share
a sequence depends on their lengths alone, so the plan is made on the histogram
of lengths (at most ``capacity`` numbers, whatever the corpus): patterns of two
and three lengths that fill a sequence are enumerated, repeat counts are fitted
to the histogram by non-negative least squares and rounded, and what is left is
packed best fit, longest first.  Each length gets ranges of ranks that say where
its first, second ... piece goes; ranks are counted where pieces are made, so
tokens are never shuffled to find their place.

Null or empty text: the end id alone.  Pieces are never dropped or shortened.
Repeated rows are packed as often as they come.  An empty table packs to none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from sheetloom.llm.base import add_columns, keep, picked, ready, table
from sheetloom.llm.tokens import encoder, vocabulary

CAPACITY = 2048
SWEEPS = 8


class Pattern(NamedTuple):
    """(length, how often) in order of place, and the number of sequences that have it."""

    parts: tuple[tuple[int, int], ...]
    times: int


def full_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of lengths that fill a sequence exactly; rows of three, 0 for none."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = []
    low = lengths[lengths <= capacity // 2]
    pairs = low[there[capacity - low]]
    out.append(np.stack((capacity - pairs, pairs, np.zeros_like(pairs)), 1))
    for a in lengths[lengths >= -(-capacity // 3)][::-1]:
        b = lengths[(lengths <= a) & (2 * lengths >= capacity - a) & (lengths < capacity - a)]
        c = capacity - a - b
        ok = there[c]
        out.append(np.stack((np.full(int(ok.sum()), a), b[ok], c[ok]), 1))
    return np.concatenate(out)


def fit(patterns: np.ndarray, counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths close to ``counts``: cyclic coordinate descent."""
    rest = counts.astype(float).tolist()
    columns = [tuple((int(v), float(row.count(v))) for v in sorted(set(row)) if v) for row in patterns.tolist()]
    squares = [sum(m * m for _, m in col) for col in columns]
    x = [0.0] * len(columns)
    active = range(len(columns))
    for _ in range(sweeps):
        moved = []
        for j in active:
            col = columns[j]
            step = sum(m * rest[v] for v, m in col) / squares[j]
            if x[j] + step < 0:
                step = -x[j]
            if step:
                x[j] += step
                for v, m in col:
                    rest[v] -= m * step
            if x[j] > 0:
                moved.append(j)
        active = moved
    return np.asarray(x)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use every piece exactly once; counts[n] is the number of pieces of length n."""
    left = [int(c) for c in counts]
    out: list[Pattern] = []
    if left[capacity]:
        out.append(Pattern(((capacity, 1),), left[capacity]))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        patterns = full_patterns(lengths, capacity)
        x = fit(patterns, np.asarray(left)) if len(patterns) else np.zeros(0)
        for j in np.argsort(-x, kind="stable").tolist():
            times = int(x[j] + 0.5)
            if times == 0:
                break
            row = [v for v in patterns[j].tolist() if v]
            parts = tuple((v, row.count(v)) for v in sorted(set(row), reverse=True))
            times = min([times, *(left[v] // m for v, m in parts)])
            if times:
                out.append(Pattern(parts, times))
                for v, m in parts:
                    left[v] -= m * times
    return out + best_fit(left, capacity)


def best_fit(left: list[int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, on counts: sequences with the same content are handled as one group."""
    groups: dict[int, list[Pattern]] = {}
    free: list[int] = []
    done: list[Pattern] = []

    def add(space: int, parts, times: int) -> None:
        if not times:
            return
        if space == 0:
            done.append(Pattern(parts, times))
            return
        if space not in groups:
            groups[space] = []
            insort(free, space)
        groups[space].append(Pattern(parts, times))

    for n in range(capacity, 0, -1):
        todo = left[n]
        while todo:
            at = bisect_left(free, n)
            if at < len(free):
                space = free[at]
                parts, times = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    free.pop(at)
            else:
                space, parts, times = capacity, (), todo
            each = min(space // n, todo)
            used = min(times, todo // each)
            add(space - each * n, parts + ((n, each),), used)
            todo -= used * each
            if used < times and parts:
                add(space, parts, times - used)
    return done + [p for patterns in groups.values() for p in patterns]


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, pieces a sequence, first sequence, offset), by first rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for parts, times in patterns:
        offset = 0
        for n, each in parts:
            rows.setdefault(n, []).append((used.get(n, 0), each, first, offset))
            used[n] = used.get(n, 0) + each * times
            offset += n * each
        first += times
    return {n: np.asarray(r, np.int64) for n, r in rows.items()}


PIECES = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("cell", T.IntegerType()),
    T.StructField("number", T.LongType())])
PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def cut(docs: DataFrame, vocab: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces with their ids and checksum; ``number`` counts the pieces of a length within a task (``cell``)."""
    schema, path = to_arrow_schema(PIECES), vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.asarray([end_id], np.uint32)
        cell, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        out: list[list] = [[] for _ in schema]

        def flush() -> pa.RecordBatch:
            done = [pa.array(c, f.type) for c, f in zip(out, schema)]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(done, schema=schema)

        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), own.lists(batch.column(1))):
                found = np.concatenate((found, end)).astype("<u4")
                for piece, at in enumerate(range(0, len(found), capacity)):
                    ids = found[at:at + capacity].tobytes()
                    n = len(ids) // 4
                    for column, value in zip(out, (key, piece, at, n, ids, zlib.crc32(ids), cell, seen[n])):
                        column.append(value)
                    seen[n] += 1
                if len(out[0]) >= 1000:
                    yield flush()
        if out[0]:
            yield flush()

    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocab: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id",
         text: str = "text", carry_ids: bool = True) -> DataFrame:
    """Pieces (key, piece, start, length, ids, ids_crc32) with ``sequence_id`` and ``offset``.

    Without ``carry_ids`` the tokens stay out of the join that finds the places; the checksum made with them is kept.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # written once: ranks counted in a task must be those of the pieces that are placed
    pieces = keep(cut(rows, vocab, end_id, capacity))
    cells = keep(pieces.groupBy("length", "cell").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    where = places(plan(counts, capacity))

    def make():
        def run(length, rank):
            length, rank = length.to_numpy(), rank.to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                rows = where[n]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                at = rank[own] - row[:, 0]
                seq[own] = row[:, 2] + at // row[:, 1]
                offset[own] = row[:, 3] + at % row[:, 1] * n
            return [pa.array(seq), pa.array(offset)]
        return run

    earlier = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select("length", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("number"))
    ranked = ranked.drop("cell", "number", "before", *([] if carry_ids else ["ids"]))
    return add_columns(ranked, make, PLACE, "length", "rank").drop("rank")


def op8_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    packed = pack(picked(table(spark, d, "documents"), "doc_id", "text"), "word_bpe_49k.json", 0,
                  carry_ids=False)
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id",
                         "offset")


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}

"""Token files: ids in ascending document order under a canonical length-limited Huffman code.

A token file is a folder of three tables that any Spark reader can open:

``codebook``  (id, length): code length of each id that occurs; codes are canonical.
``blocks``    one row per independent block: part, block, start (ids before it in
              its part), the ids and lengths of its documents, bit offsets of
              every ``STRIDE``-th id, the code bits (32-bit big-endian words) and their CRC.
``manifest``  (part, start): ids before each part.

Code lengths come from the counts of all ids by package-merge.  Decoding looks
``LIMIT`` bits up in a table; the bit offsets let it run at many places of a block
at once.  Null text: the end id alone.  Null keys come first; repeated keys stay
apart, ordered by length and checksum.  An empty table gives an empty file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheetloom.llm.base import keep, picked, ready, table
from sheetloom.llm.tokens import small_ids, vocabulary, with_ids
from sheetloom.plans.lineage import shared_folder

LIMIT = 18
STRIDE = 128
#: Ids of a block, beyond a single longer document, and of a part.
BLOCK, PART = 1 << 18, 1 << 23

BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())),
    T.StructField("bits", T.BinaryType()), T.StructField("crc", T.LongType())])
_blocks = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()),
                     ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                     ("offsets", pa.list_(pa.int64())), ("bits", pa.binary()), ("crc", pa.int64())])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    level, leaves = weights, []
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((weights, packages))
        by = np.argsort(merged, kind="stable")
        leaves.append(by < n)
        level = merged[by]
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by (length, id), and the code of each: counting up, shifted where the length grows."""
    order = np.lexsort((ids, lengths))
    steps = np.uint64(1) << (np.uint64(LIMIT) - lengths[order].astype(np.uint64))
    left = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps)[:-1])) if len(order) else steps
    return order, left >> (np.uint64(LIMIT) - lengths[order].astype(np.uint64))


class Code:
    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order, codes = canonical(ids, lengths)
        ids, lengths = ids[order], lengths[order]
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.code[ids], self.length[ids] = codes, lengths
        spans = np.int64(1) << (LIMIT - lengths.astype(np.int64))
        self.id_at, self.bits_at = np.repeat(ids, spans).astype(np.uint32), np.repeat(lengths, spans).astype(np.int64)
        if len(self.id_at) < 1 << LIMIT:  # one id alone leaves codes unused
            pad = (1 << LIMIT) - len(self.id_at)
            self.id_at = np.concatenate((self.id_at, np.zeros(pad, np.uint32)))
            self.bits_at = np.concatenate((self.bits_at, np.ones(pad, np.int64)))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Code bits and the bit offset of every STRIDE-th id."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        shifted = self.code[ids] << (np.uint64(64) - (starts & np.uint64(31)) - lengths)
        word = starts >> np.uint64(5)
        # a code is shorter than a word, so that an id begins in every word
        first = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        out = np.zeros(len(first) + 1, np.uint64)
        out[:-1] = np.add.reduceat(shifted >> np.uint64(32), first)
        out[1:] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes(), starts[::STRIDE].astype(np.int64)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All ids of a block; every stretch of STRIDE ids is read at the same time."""
        words = np.concatenate((np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)))
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = offsets.astype(np.int64)
        out = np.zeros((STRIDE, len(at)), np.uint32)
        for i in range(STRIDE):
            if (len(at) - 1) * STRIDE + i >= n:  # the last stretch is shorter
                at = at[:-1]
                if not len(at):
                    break
            window = (pairs[at >> 5] >> (64 - LIMIT - (at & 31)).astype(np.uint64)) & np.uint64((1 << LIMIT) - 1)
            out[i, :len(at)] = self.id_at[window]
            at = at + self.bits_at[window]
        return out.T.reshape(-1)[:n]


def count_ids(tokens: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and their counts: as many as the vocabulary has entries, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                own = np.bincount(np.frombuffer(raw, kind))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    rows = (tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
            .orderBy("id").toPandas())
    return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def write_token_file(docs: DataFrame, folder: str, vocab: str, end_id: int, key: str = "doc_id",
                     text: str = "text", part: int = PART) -> None:
    """Writes the token file of ``docs`` to ``folder``; ``key`` is a whole number."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    kind = "<u2" if small_ids(vocabulary(vocab), end_id) else "<u4"
    tokens = keep(with_ids(rows, vocabulary(vocab), end_id, kind=kind).select("key", "n_tokens", "ids"))
    ids, counts = count_ids(tokens, kind)
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(x)) for i, x in zip(ids, lengths)], "id long, length int").coalesce(1) \
        .write.parquet(f"{folder}/codebook")
    total, width = int(counts.sum()), int(kind[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number, block, before = Code(ids, lengths), TaskContext.get().partitionId(), 0, 0
        keys, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = [len(x) // width for x in held]
            bits, offsets = code.encode(np.frombuffer(b"".join(held), kind))
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int32()), pa.array([block], pa.int32()), pa.array([before]),
                pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([offsets], pa.list_(pa.int64())), pa.array([bits], pa.binary()),
                pa.array([zlib.crc32(bits)], pa.int64())], schema=_blocks)

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                held.append(raw)
                size += len(raw) // width
                if size >= BLOCK:
                    yield flush()
                    block, before, keys, held, size = block + 1, before + size, [], [], 0
        if held:
            yield flush()

    (tokens.repartitionByRange(max(1, -(-total // part)), "key")
     .sortWithinPartitions("key", "n_tokens", F.crc32("ids")).select("key", "ids")
     .mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks"))
    written = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = written.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    # one row per part: a few bytes for each 8 million ids
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")) \
        .write.parquet(f"{folder}/manifest")


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids): every document of the file, ids as 32-bit little-endian bytes."""
    ready(spark)
    book = spark.read.parquet(f"{folder}/codebook").toPandas()
    ids, lengths = book["id"].to_numpy(np.int64), book["length"].to_numpy(np.uint8)
    names = ["key", "start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(ids, lengths)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["bits"]) != row["crc"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                sizes = np.asarray(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                raw = code.decode(row["bits"], np.asarray(row["offsets"]), int(ends[-1])).astype("<u4").tobytes()
                starts = ends - sizes
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["keys"], pa.int64()), pa.array(starts + row["start"]), pa.array(sizes),
                    pa.array([raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                    names=names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    parts = spark.read.schema("part int, start long").parquet(f"{folder}/manifest").withColumnRenamed("start", "base")
    placed = blocks.join(parts, "part").select(F.col("part"), "block", (F.col("start") + F.col("base")).alias("start"),
                                               "keys", "lengths", "offsets", "bits", "crc")
    return placed.mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def op7_token_file(spark: SparkSession, d: str) -> DataFrame:
    docs = picked(table(spark, d, "documents"), "doc_id", "text")
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, folder, "byte_bpe_50k.json", 2)
    return read_token_file(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens",
                                                 F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op7_token_file": op7_token_file}
ORACLES: dict[str, str] = {}

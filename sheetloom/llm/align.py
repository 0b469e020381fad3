"""Alignment of two tokenizers over the same bytes.

Texts become Arrow lists of token ids.  The lists are flattened with their parent
indices; byte lengths of tokens, taken from tables of the vocabularies, are summed
per document, so that a token is known by its document and the byte it ends at.
An Acero full outer join of both tokenizers' ends cuts each document into the
smallest stretches of bytes: one for each pair of tokens that overlap.  Ends that
both have close a group.

Counts of id pairs are made per task with ``Table.group_by`` and added up by Spark.
They return to the documents by a join of each document's distinct pairs: at most
``COMMON`` of the most frequent pairs are broadcast, whatever the corpus, and the
rows of all rarer ones are joined by a shuffle, in which no pair has many rows.

A document whose text is null or empty, or whose tokens of either kind don't give
a blank and the text byte for byte, has no tokens: zeros and an empty digest.
Repeated rows are documents of their own and a null id stays null.  An empty table
gives no rows.  Only the named columns are read, so others can have any name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetloom.functions.exprs import ident
from sheetloom.llm.base import keep, picked, ready, table
from sheetloom.llm.tokens import byte_signs, encoder, vocabulary

#: Bytes of text that are aligned at a time, beyond a single longer text.
BYTES = 1 << 20
#: Pairs that are broadcast: at most so many, the most frequent ones.
COMMON = 1 << 18
#: Pairs a task counts before it sends its counts on.
HELD = 1 << 20
#: Units whose pieces a worker remembers.
UNITS = 1 << 19
#: Blanks and what follows: no piece of the vocabulary has a blank after another character.
UNIT = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")
#: What follows an id in the digest's text.
SIGNS = (",", "|", ";", "")


class Pieces:
    """Ids and bytes of a sentencepiece vocabulary."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                      for i, n in enumerate(names)]
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("a piece goes on after a blank, so texts cannot be cut at blanks")
        self.blank = array("i", [self.model.piece_to_id("▁")])
        self.units: dict[str, array] = {}

    def unit(self, unit: str) -> array:
        found = self.units.get(unit)
        if found is None:
            if len(self.units) >= UNITS:
                self.units.clear()
            # the model itself puts the first blank
            found = self.units[unit] = array("i", self.model.encode(unit[1:])) if unit != " " else self.blank
        return found

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, of which the first blank is there."""
        return np.frombuffer(b"".join(map(self.unit, UNIT.findall(text))), np.int32)


class Side:
    """Tables of a vocabulary: bytes of each id, their number, and the id in decimal with each of ``SIGNS``."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.lengths = pc.cast(pc.binary_length(self.bytes), pa.int64())
        self.signed = pa.array([f"{i}{s}" for s in SIGNS for i in range(len(tokens))], pa.large_string())
        self.size = len(tokens)

    def raw(self, ids: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids in turn, and where each ends."""
        taken = self.bytes.take(ids)
        return memoryview(taken.buffers()[2] or b"").cast("B"), np.frombuffer(taken.buffers()[1], np.int64)[1:len(ids) + 1]


@lru_cache(maxsize=1)
def vocabularies(path_a: str, path_b: str):
    pa.set_cpu_count(1)  # a task has one core
    own = encoder(path_a)
    signs = {s: b for b, s in byte_signs().items()}
    names = sorted(own.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
    # tokens that are added to the vocabulary aren't written in its signs, and no text gives them
    first = [bytes(signs.get(c, 0) for c in name) for name, _ in names]
    pieces = Pieces(path_b)
    return own, pieces, Side(first), Side(pieces.bytes)


def lists(parts: list[np.ndarray]) -> pa.LargeListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat))


def spells(side: Side, tokens: pa.LargeListArray, texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of each list of ids are those of its text."""
    raw, ends = side.raw(tokens.flatten())
    bounds = np.concatenate(([0], ends))[tokens.offsets.to_numpy()].tolist()
    return np.array([raw[a:b] == t for a, b, t in zip(bounds, bounds[1:], texts)], bool)


def ends_of(side: Side, tokens: pa.LargeListArray, name: str) -> pa.Table:
    """(doc, end, name): the byte of its document that each token ends at, and its id."""
    ids, doc = tokens.flatten(), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(side.lengths.take(ids))
    # sums start again with each document
    offsets = tokens.offsets.to_numpy()
    upto = np.concatenate(([0], total.to_numpy()))[offsets[:-1]]
    return pa.table({"doc": doc, "end": pc.subtract(total, pa.array(upto).take(doc)), name: ids})


def overlaps(first: pa.Table, second: pa.Table) -> pa.Table:
    """(doc, end, a, b, a_end, b_end) in order: each stretch of bytes within one token of each kind, and which end there."""
    joined = first.join(second, ["doc", "end"], join_type="full outer", use_threads=False)
    joined = joined.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    # the token that covers a stretch is the next to end: a document's last byte ends both
    return pa.table({"doc": joined["doc"], "end": joined["end"], "a": pc.fill_null_backward(joined["a"]),
                     "b": pc.fill_null_backward(joined["b"]), "a_end": pc.is_valid(joined["a"]),
                     "b_end": pc.is_valid(joined["b"])})


def digests(side_a: Side, side_b: Side, cut: pa.Table, n: int) -> list[str]:
    """SHA-256 of each document's groups written as `a1,a2|b1;a3|b2,b3`."""
    a_end, b_end = cut["a_end"].to_numpy(), cut["b_end"].to_numpy()
    both, doc = a_end & b_end, cut["doc"].to_numpy()
    last = np.concatenate((doc[1:] != doc[:-1], [True]))[:len(doc)]
    group = np.cumsum(both) - both
    # within a group all tokens of the first kind come before those of the second
    upto_a = np.concatenate(([0], np.cumsum(a_end)[both]))
    upto_b = np.concatenate(([0], np.cumsum(b_end)[both]))
    of_a, of_b = group[a_end], group[b_end]
    place_a = np.arange(len(of_a)) + upto_b[of_a]
    place_b = np.arange(len(of_b)) + upto_a[of_b + 1]
    sign_a = np.where(both[a_end], 1, 0)
    sign_b = np.where(both[b_end], np.where(last[b_end], 3, 2), 0)
    code = np.empty(len(of_a) + len(of_b), np.int64)
    code[place_a] = cut["a"].to_numpy()[a_end] + sign_a * side_a.size
    code[place_b] = cut["b"].to_numpy()[b_end] + sign_b * side_b.size + side_a.size * len(SIGNS)
    signed = pa.concat_arrays([side_a.signed, side_b.signed]).take(pa.array(code))
    ends = np.frombuffer(signed.buffers()[1], np.int64)[:len(code) + 1]
    text = memoryview(signed.buffers()[2] or b"").cast("B")
    per_doc = np.bincount(doc, a_end.astype(np.int64) + b_end, n).astype(np.int64)
    bounds = ends[np.concatenate(([0], np.cumsum(per_doc)))].tolist()
    return [hashlib.sha256(text[a:b]).hexdigest() if b > a else "" for a, b in zip(bounds, bounds[1:])]


FIELDS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())),
    T.StructField("times", T.ArrayType(T.IntegerType()))])


def aligned_batch(texts: list[str | None], path_a: str, path_b: str) -> list[pa.Array]:
    """The columns of ``FIELDS`` after the key for some texts."""
    own, pieces, side_a, side_b = vocabularies(path_a, path_b)
    n = len(texts)
    spaced = [" " + t if t else "" for t in texts]
    raw = [t.encode() for t in spaced]
    a = lists(list(own.lists(pa.array(spaced, pa.large_string()))))
    b = lists([pieces.ids(t) for t in spaced])
    none = pa.array(np.zeros(0, np.int32))
    good = spells(side_a, a, raw) & spells(side_b, b, raw)
    if not good.all():
        a, b = (lists([x.values.to_numpy()[s:e] if ok else none.to_numpy() for s, e, ok in
                       zip(x.offsets.to_numpy()[:-1].tolist(), x.offsets.to_numpy()[1:].tolist(), good.tolist())])
                for x in (a, b))
    cut = overlaps(ends_of(side_a, a, "a"), ends_of(side_b, b, "b"))
    doc = cut["doc"].to_numpy()
    groups = np.bincount(doc, cut["a_end"].to_numpy() & cut["b_end"].to_numpy(), n).astype(np.int64)
    pair = pc.bit_wise_or(pc.shift_left(cut["a"].cast(pa.int64()), 32), cut["b"].cast(pa.int64()))
    seen = pa.table({"doc": cut["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False) \
        .aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(seen["doc"].to_numpy(), minlength=n)))), pa.int32())

    def per_doc(column: str, kind: pa.DataType) -> pa.Array:
        flat = seen[column].cast(kind)
        return pa.ListArray.from_arrays(bounds, flat.chunk(0) if flat.num_chunks else pa.array([], kind))

    return [pc.cast(pc.list_value_length(a), pa.int64()), pc.cast(pc.list_value_length(b), pa.int64()), pa.array(groups),
            pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(digests(side_a, side_b, cut, n), pa.string()),
            per_doc("pair", pa.int64()), per_doc("count_all", pa.int32())]


def some(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``limit`` in sum, or of one."""
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths)


def align(docs: DataFrame, vocab_a: str, vocab_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts and digest, distinct ``pairs`` (first id << 32 | second) and their ``times``."""
    ready(docs.sparkSession)
    schema, path_a, path_b = to_arrow_schema(FIELDS), vocabulary(vocab_a), vocabulary(vocab_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for lo, hi in some(size, BYTES):
                part = batch.slice(lo, hi - lo)
                found = aligned_batch(part.column(2).to_pylist(), path_a, path_b)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *found], schema=schema)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident(key)).cast("long").alias("key"),
                       F.col(ident(text)).alias("text")).mapInArrow(run, FIELDS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents have a pair linked, and whether none of its first id's has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for batch in batches:
            new = pa.table({"pair": pc.list_flatten(batch.column(0))}).group_by("pair", use_threads=False) \
                .aggregate([([], "count_all")]).rename_columns(["pair", "n"])
            held = pa.concat_tables([held, new]).group_by("pair", use_threads=False) \
                .aggregate([("n", "sum")]).rename_columns(["pair", "n"])
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = held.slice(0, 0)
        yield from held.to_batches()

    counted = keep(aligned.select("pairs").mapInArrow(run, "pair long, n long")
                   .groupBy("pair").agg(F.sum("n").alias("count")))
    first = F.shiftright("pair", 32)
    # a row for each id of a vocabulary at most
    most = F.broadcast(counted.groupBy(first.alias("first")).agg(F.max("count").alias("most")))
    return counted.join(most, first == F.col("first")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, common: int = COMMON) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` from ``counts`` in place of its pairs.  Both should be tables."""
    # the smallest power of two such that at most ``common`` pairs have that count: 64 numbers at most
    power = F.floor(F.log2("count")).cast("int")
    found = sorted(counts.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, total = 64, 0
    for p, n in found:
        total += n
        if total > common:
            break
        least = p
    often = F.broadcast(counts.where(power >= least))
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    each = each.withColumnRenamed("pairs", "pair")
    known = each.join(often, "pair")
    if least > min([p for p, _ in found], default=64):
        rare = each.join(often.select("pair"), "pair", "left_anti")
        known = known.unionByName(rare.join(counts.where(power < least).hint("shuffle_hash"), "pair"))
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
                                    F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (aligned.drop("pairs", "times").join(sums, "row", "left").drop("row")
            .withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}))


def op11_token_alignment(spark: SparkSession, d: str) -> DataFrame:
    docs = picked(table(spark, d, "documents"), "doc_id", "text")
    aligned = keep(align(docs, "byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = with_counts(aligned, keep(pair_counts(aligned)))
    return found.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}

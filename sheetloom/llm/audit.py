"""Audit of quality filters that interact: sorted lists of failing rows, merged by galloping.

Every row of a part gets a number; numbers fall into ranges of at most ``RANGE``.
For each part and range the numbers that fail a filter are kept as a sorted list,
and so are those labelled good and toxic.  A task takes the lists of one part and
range at a time: k-way merges give the rows that any set of filters removes, and
differences the rows that one more filter removes after them.  Merges gallop: a
run of one list that lies below the heads of all others is found by doubling steps
and copied at once.  Only sizes leave the task; they add up over ranges, and every
order of the filters reads its steps from them.

A null text is empty, a null part is the empty string.  A null id has no label, is
no copy of another and is an original for none.  Rows with the same id and text
each count; neither is a copy of the other.  An empty table gives no rows.  Only
the named columns are read, so further columns can have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.exprs import ident
from sheetloom.llm.base import add_columns, join_unique, keep, picked, ready, table

#: Rows of a range, as a power of two.
RANGE = 16
#: Parts whose sums a task holds before it sends them on.
PARTS = 1000
#: The filters, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS = 200
#: Percent of distinct words below which a text fails.
MIN_DISTINCT = 50
#: Percent of capitals above which a text fails.
MAX_CAPITALS = 2

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = b"#$%&*|"
_CONTINUES = bytes(range(0x80, 0xC0))


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = raw.split()  # bytes are split at \\x20 and \\x09-\\x0D alone
    points = len(raw.translate(None, _CONTINUES))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * capitals > MAX_CAPITALS * points) << 2 | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3)


def gallop(x: Sequence[int], value: int, at: int) -> int:
    """The first place from ``at`` on that holds ``value`` or more."""
    step, n = 1, len(x)
    while at < n and x[at] < value:
        low = at + 1
        at += step
        step *= 2
        if at >= n or x[at] >= value:
            return bisect_left(x, value, low, min(at, n))
    return at


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """The numbers that are in any of some sorted lists."""
    at = [0] * len(lists)
    heads = [(x[0], i) for i, x in enumerate(lists) if x]
    heapify(heads)
    out: list[int] = []
    while heads:
        _, i = heappop(heads)
        own = lists[i]
        if not heads:
            out.extend(own[at[i]:])
            break
        to = gallop(own, heads[0][0], at[i])
        if to == at[i]:  # another list has this number as well
            to += 1
        else:
            out.extend(own[at[i]:to])
        at[i] = to
        if to < len(own):
            heappush(heads, (own[to], i))
    return out


def difference(x: Sequence[int], y: Sequence[int]) -> list[int]:
    """The numbers of one sorted list that another has not."""
    out: list[int] = []
    i = j = 0
    while i < len(x):
        j = gallop(y, x[i], j)
        if j == len(y):
            out.extend(x[i:])
            break
        if y[j] == x[i]:
            i, j = i + 1, j + 1
            continue
        to = gallop(x, y[j], i)
        out.extend(x[i:to])
        i = to
    return out


def common(x: Sequence[int], y: Sequence[int]) -> int:
    """How many numbers two sorted lists share."""
    i = j = n = 0
    while i < len(x):
        j = gallop(y, x[i], j)
        if j == len(y):
            break
        if y[j] == x[i]:
            n, i = n + 1, i + 1
        else:
            i = gallop(x, y[j], i)
    return n


def step_sizes(lists: Sequence[Sequence[int]], good: Sequence[int], toxic: Sequence[int]) -> list[list[int]]:
    """[gone after the step, removed by it, good and toxic ones of these] for each set of earlier filters, each filter."""
    out = []
    for seen in range(1 << len(lists)):
        before = union([x for f, x in enumerate(lists) if seen >> f & 1])
        for f, x in enumerate(lists):
            if not seen >> f & 1:
                new = difference(x, before)
                out.append([len(before) + len(new), len(new), common(new, good), common(new, toxic)])
    return out


def steps(k: int) -> list[tuple[int, int]]:
    """(set of earlier filters, filter) in the order of ``step_sizes``."""
    return [(seen, f) for seen in range(1 << k) for f in range(k) if not seen >> f & 1]


def postings(flags: DataFrame, k: int) -> DataFrame:
    """(part, range, n, lists, good, toxic): sorted lists of row numbers for each part and range of ``flags``
    (part, row, failed, good, toxic)."""

    def held(when: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(when, F.col("row"))))

    bit = [F.col("failed").bitwiseAND(F.lit(1 << f)) != 0 for f in range(k)]
    grouped = flags.groupBy("part", F.shiftright("row", RANGE).alias("range")).agg(
        F.count("*").alias("n"), *[held(b).alias(f"fail{f}") for f, b in enumerate(bit)],
        held(F.col("good")).alias("good"), held(F.col("toxic")).alias("toxic"))
    return grouped.select("part", "range", "n", F.array(*[f"fail{f}" for f in range(k)]).alias("lists"), "good", "toxic")


def sizes(posted: DataFrame, k: int) -> DataFrame:
    """(part, n, seen, filter, gone, removed, good, toxic): sums of a task's ranges."""
    ready(posted.sparkSession)
    names = ["part", "n", "seen", "filter", "gone", "removed", "good", "toxic"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(part, n, seen, f, *counts) for part, (n, sums) in held.items()
                    for (seen, f), counts in zip(steps(k), sums)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                part, n, lists, good, toxic = (batch.column(c)[i].as_py() for c in range(5))
                new = step_sizes(lists, good, toxic)
                n0, sums = held.get(part, (0, [[0] * 4] * len(new)))
                held[part] = (n0 + n, [[a + b for a, b in zip(x, y)] for x, y in zip(sums, new)])
                if len(held) >= PARTS:
                    yield flush()
        if held:
            yield flush()

    # lists are small for the work they give, so they are dealt by number, not by size
    tasks = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = posted.repartition(tasks, "part", "range").drop("range")
    return dealt.mapInArrow(run, "part string, n long, seen int, filter int, gone long, removed long, good long, toxic long")


def audit(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``flags`` (part, row, failed, good, toxic).

    ``row`` numbers the rows, ``failed`` has a bit for each filter that a row fails.
    """
    k = len(filters)
    spark = flags.sparkSession
    parts = sizes(keep(postings(flags, k)), k)
    sums = [F.sum(c).alias(c) for c in ("n", "gone", "removed", "good", "toxic")]
    total = parts.groupBy("part", "filter", "seen").agg(*sums)
    # an order puts |seen| filters before one and the others after it
    before = F.bit_count("seen")
    orders = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), before + 1)
    others = F.element_at(F.array(*[F.lit(((1 << k) - 1) ^ (1 << f)) for f in range(k)]), F.col("filter") + 1)
    by_filter = total.groupBy("part", "filter").agg(
        F.collect_list(F.struct("n", "seen", "gone", "removed", "good", "toxic")).alias("cases"),
        F.max(F.when(F.col("seen") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("seen") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).alias("shapley"))
    cases = by_filter.select("part", "filter", "fails", "unique_fails", "shapley", F.inline("cases"))
    rows = []
    for order in permutations(range(k)):
        name = "".join(filters[f] for f in order)
        rows += [(name, i + 1, f, sum(1 << x for x in order[:i])) for i, f in enumerate(order)]
    # as many rows as there are steps of orders, whatever the tables
    asked = F.broadcast(spark.createDataFrame(rows, "filter_order string, step int, filter int, seen int"))
    return cases.join(asked, ["filter", "seen"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), "shapley")


def text_flags(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
               part: str = "source") -> DataFrame:
    """(part, row, failed, good, toxic) of the filters A to E for every row of ``docs``.

    ``labels`` has the columns of ``key``, quality and toxic; of several rows of an id any can say 1.
    """
    ready(docs.sparkSession)

    def make():
        def run(column):
            raw = column.cast(pa.large_binary()).to_pylist()
            return [pa.array([failures(x) for x in raw], pa.int32())]
        return run

    source = docs.select(F.col(ident(key)).cast("long").alias("id"), F.coalesce(F.col(ident(part)), F.lit("")).alias("part"),
                         F.coalesce(F.col(ident(text)), F.lit("")).alias("text"))
    found = add_columns(source, make, T.StructType([T.StructField("failed", T.IntegerType())]), "text")
    rows = keep(found.select(F.monotonically_increasing_id().alias("row"), "id", "part", "failed",
                             F.unhex(F.sha2("text", 256)).alias("digest")))
    # texts that come twice, with the smallest id that has them
    copied = keep(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first"))
                  .where("n > 1").select("digest", "first"))
    is_copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    marked = join_unique(rows, copied, "digest").select(
        "id", "part", "row", F.col("failed").bitwiseOR(F.shiftleft(is_copy, 4)).alias("failed"))
    says = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    named = keep(labels.where(F.col(ident(key)).isNotNull()).groupBy(F.col(ident(key)).cast("long").alias("id")).agg(*says))
    no = F.lit(False)
    return join_unique(keep(marked), named, "id").select(
        "part", "row", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def op13_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = picked(table(spark, d, "documents"), "doc_id", "text", "source")
    labels = picked(table(spark, d, "labels"), "doc_id", "quality", "toxic")
    return audit(keep(text_flags(docs, labels)))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
named AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
       + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts LEFT JOIN named USING (doc_id)),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, mask),
letters AS (SELECT i AS f, chr(65 + i::INT) AS c FROM range(5) r(i)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.f, b.f, c.f, d.f, e.f] AS fs
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, i::INT AS step, (1::BIGINT << fs[i]) AS own,
         list_sum(list_transform(fs[1:i], lambda x: 1::BIGINT << x))::BIGINT AS upto
  FROM orders, range(1, 6) r(i)),
counted AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & upto = own THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 THEN n ELSE 0 END) AS fails,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & upto = own THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & upto = own THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       (fails - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted"""}

"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of at most ``BLOCK`` vectors; every
pair of blocks is one task's matrix product of int8 codes.  The codes bound each
cosine from both sides, so pairs that can't be among a query's nearest are
dropped without loss; the rest is recomputed in double precision on the original
vectors.  Each block pair keeps a heap of k per query, and the heaps are merged.

Rows whose vector is null, empty, zero or has a null or non-finite component,
or whose id is null, take no part.  Vectors of unlike length are compared with
their own length only.  Ties go to the smaller id; a repeated row counts once per repetition.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.llm.base import keep, picked, ready, table

BLOCK = 8192
#: Candidates at a time in one product, so that a tile stays within some tens of megabytes.
TILE = 2048
RESULT = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Finite in all components and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers must not overflow
    y = x / scale
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, step per row, and the norms of what the codes stand for and of what they miss."""
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    stands = codes * step[:, None]
    return codes, step, np.sqrt((stands * stands).sum(1)), np.sqrt(((unit - stands) ** 2).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows of original vectors, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest_in_block(q_ids, q_rows, q_self, c_ids, c_rows, c_self, k: int):
    """Up to k nearest candidates per query: rows (query position, candidate id, score).

    ``self`` numbers tell a query's own row from another one with the same id.
    """
    q_unit, c_unit = unit_rows(q_rows), unit_rows(c_rows)
    q_code, q_step, q_norm, q_miss = quantise(q_unit)
    c_code, c_step, _, c_miss = quantise(c_unit)
    q_float = q_code.astype(np.float32)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    for at in range(0, len(c_ids), TILE):
        part = slice(at, at + TILE)
        # float32 holds the integer products exactly as long as they stay below 2**24
        exact = q_code.shape[1] * 127 * 127 < 1 << 24
        left = q_float if exact else q_code.astype(np.float64)
        product = left @ c_code[part].astype(left.dtype).T
        near = product * q_step[:, None] * c_step[part]
        slack = q_norm[:, None] * c_miss[part] + q_miss[:, None] + 1e-6
        near[q_self[:, None] == c_self[part]] = -np.inf
        n = near.shape[1]
        if n > k:
            low = np.partition(near - slack, n - k, axis=1)[:, n - k]
            bound = np.maximum(floor, low)
        else:
            bound = floor
        rows, cols = np.nonzero((near + slack >= bound[:, None]) & (near > -np.inf))
        for s in range(0, len(rows), 1 << 16):
            r, c = rows[s:s + (1 << 16)], cols[s:s + (1 << 16)] + at
            for i, cid, score in zip(r.tolist(), c_ids[c].tolist(), cosines(q_rows[r], c_rows[c]).tolist()):
                entry = (score, -cid)
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], entry)
                elif entry > heaps[i][0]:
                    heapq.heapreplace(heaps[i], entry)
        for i, heap in enumerate(heaps):
            if len(heap) == k:
                floor[i] = heap[0][0] - 1e-9
    return [(i, -neg, score) for i, heap in enumerate(heaps) for score, neg in heap]


def _block_pair(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            q = np.stack(queries["v"].to_numpy()).astype(np.float64)
            c = np.stack(candidates["v"].to_numpy()).astype(np.float64)
            q_ids = queries["id"].to_numpy()
            found = nearest_in_block(q_ids, q, queries["n"].to_numpy(), candidates["id"].to_numpy(), c,
                                     candidates["n"].to_numpy(), k)
            out = [(q_ids[i], queries["n"].iat[i], cid, s) for i, cid, s in found]
        return pd.DataFrame(out, columns=["query_id", "n", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
            query_every: int = 50, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose id is divisible by ``query_every``."""
    ready(vectors.sparkSession)
    v = F.col("v")
    rows = (vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull() & usable(v))
            .withColumns({"n": F.monotonically_increasing_id(), "dim": F.size("v")}))
    # written once: the numbers of rows must be the same on both sides
    rows = keep(rows)
    is_query = F.col("id") % query_every == 0
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_q = max(1, -(-sizes["q"] // block))
    n_c = max(1, -(-sizes["n"] // block), min(2 * cores, -(-sizes["n"] // TILE)))

    def side(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("n"), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    queries = side(rows.where(is_query), "qb", n_q, "cb", n_c)
    candidates = side(rows, "cb", n_c, "qb", n_q)
    cell = ["dim", "qb", "cb"]
    found = (queries.groupBy(*cell).cogroup(candidates.groupBy(*cell))
             .applyInPandas(_block_pair(k), "query_id long, n long, vec_id long, score double"))
    best = Window.partitionBy("query_id", "n").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op2_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest(picked(table(spark, d, "embeddings"), "vec_id", "embedding"))


QUERIES = {"op2_nearest_neighbours": op2_nearest_neighbours}
ORACLES = {"op2_nearest_neighbours": """
WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""}

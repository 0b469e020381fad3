"""What the operators share: tables, written intermediate results, workers that find the package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sheetloom.functions.exprs import ident
from sheetloom.plans.lineage import shared_folder

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Whether Spark removes the shuffle files of a job when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once to the folder all executors share and reads it back.

    Later jobs start from the files, so a lost executor costs no recomputation
    of what came before, and joins see true sizes.  Shuffle files of the job that
    writes them are not needed any more and go at its end.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def picked(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns only, so that extra columns can't clash with working names."""
    return df.select(*[F.col(ident(c)) for c in cols])


#: A key of more than one in so many rows is joined apart from the others.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with ``right``, which has each key once, when a few keys may hold most rows of ``left``.

    Keys that more than one row in ``HOT`` has, fewer than ``HOT`` by number, are looked up in a broadcast table and
    don't move; the others are joined by a shuffle.  Rows with a null key get nulls.  Both sides should be tables.
    """
    total = left.count()
    hot = keep(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
               .where(F.col("__n") * HOT > total).select(key))
    few = F.broadcast(keep(right.join(F.broadcast(hot), key, "left_semi")))
    hot = F.broadcast(hot)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
    there = left.where(F.col(key).isNotNull())
    return (there.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, "left")
            .unionByName(there.join(hot, key, "left_semi").join(few, key, "left"))
            .unionByName(left.where(F.col(key).isNull()).select("*", *empty)))


def words_of(text: Column) -> Column:
    """Number of words of a text, null as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ready(spark: SparkSession) -> SparkSession:
    """Python workers of this session find this package when it isn't installed."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark


def add_columns(df: DataFrame, make: Callable[[], Callable[..., list]], fields: T.StructType, *inputs: str) -> DataFrame:
    """Appends columns that a Python function computes from Arrow batches.

    ``make`` runs once per task and returns a function that takes the arrays of
    ``inputs`` and returns one array per field.  Other columns pass through; one
    that has the name of a new column gives way to it.
    """
    names = {f.name for f in fields}
    old = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*old, *fields])
    work = df.select(*[F.col(ident(f.name)) for f in old],
                     *[F.col(ident(c)).alias(f"__in{i}") for i, c in enumerate(inputs)])
    width, kept = len(old), [f.name for f in old] + [f.name for f in fields]
    types = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            cols = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t)
                    for x, t in zip(fn(*batch.columns[width:]), types.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *cols], names=kept)

    return work.mapInArrow(run, schema)

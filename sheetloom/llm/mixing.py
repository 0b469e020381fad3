"""Mixing sources to target weights by entropy balancing.

Each document of a source gets a rate r, 0 < r <= 2, such that the source's words
times rates meet its target and the rates stay as close to 1 as possible in
relative entropy.  The optimum is an exponential tilt, r = min(2, exp(t * size /
mean size)), with one multiplier t per source: the convex dual, solved by Newton
steps that are safeguarded by bisection.  One step is one grouped sum over the
distinct (source, size) pairs, for all sources at the same time.  Rates are kept
as multiples of 2^-20, so that every sum is exact and reruns agree to the bit.

Rates become copies (0, 1 or 2) without chance: in order of size the running sum
of rates is rounded, each group of documents of equal size takes the difference,
and what is then missing or too much is made up with the shortest documents.

Null text: size 0, never taken.  Null source: a source of its own, last.  Groups
of equal size are cut into cells of about ``CELL`` documents by a hash of the id,
so a group with a third of all rows is spread.  Repeated rows: each is a document
(those with the same id lie in the same cell).  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions.exprs import ident
from sheetloom.llm.base import keep, picked, table, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
STEPS = 60
CELL = 8192
GRID = 1 << 20
#: A source is solved when it misses its target by less than this part of it.
TOLERANCE = 1e-6
DEC = "decimal(38,0)"


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` of each source (``source``, ``source_size``): its weight's part of the mix, at most ``most`` sizes.

    What is cut off goes to the others by weight until nobody is above, which is
    the level at which sum(min(most * size, weight * level)) is the mix.  One row
    per source passes one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = (sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
              .withColumn("full_at", F.col("cap") / F.col("weight")))
    everyone = Window.partitionBy()
    lower = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.orderBy("full_at", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("cap").over(lower), F.lit(0.0)))
             / F.sum("weight").over(upper))
    # counting too many as full only lowers the level, so the highest that fits is the one
    return (capped.withColumn("level", level)
            .withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everyone))
            .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
            .select("source", "source_size", "target"))


def rate_of(tilt: Column, size: Column, mean: Column, full: Column) -> Column:
    """Rate in multiples of 1 / GRID; ``full`` sources take everything twice, empty documents nothing."""
    rate = F.least(F.lit(float(MOST)), F.exp(F.least(tilt * size / mean, F.lit(1.0))))
    return (F.when(size == 0, 0).when(full, MOST * GRID)
            .otherwise(F.floor(rate * GRID + 0.5)).cast("long"))


def tilts(groups: DataFrame, goals: DataFrame, steps: int = STEPS) -> DataFrame:
    """``tilt`` per source: distributed Newton iterations on the dual of the entropy problem."""
    open_ = (F.col("target") < F.col("cap")) & (F.col("target") > 0)
    state = keep(goals.withColumn("cap", F.col("source_size") * float(MOST))
                 .withColumns({"mean": F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0)),
                               "full": F.col("target") >= F.col("cap"), "tilt": F.lit(0.0),
                               "low": F.lit(-1e3), "high": F.lit(1e3), "done": ~open_}))
    for _ in range(steps):
        if state.where(~F.col("done")).isEmpty():
            break
        size, tilt = F.col("size"), F.col("tilt")
        rate = rate_of(tilt, size, F.col("mean"), F.col("full"))
        words = F.col("docs").cast(DEC) * size.cast(DEC) * rate.cast(DEC)
        moved = F.when(rate < MOST * GRID, (words * size.cast(DEC)).cast(DEC))
        sums = (groups.join(state.where(~F.col("done")), groups["source"].eqNullSafe(state["source"]))
                .select(state["source"].alias("of"), words.cast(DEC).alias("words"), moved.alias("moved"))
                .groupBy("of").agg(F.sum("words").cast("double").alias("words"),
                                   F.coalesce(F.sum("moved"), F.lit(0)).cast("double").alias("moved")))
        joined = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left").drop("of")
        miss = F.col("words") / GRID - F.col("target")
        slope = F.col("moved") / GRID / F.col("mean")
        low = F.when(miss < 0, tilt).otherwise(F.col("low"))
        high = F.when(miss >= 0, tilt).otherwise(F.col("high"))
        newton = tilt - miss / slope
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        following = F.when(inside, newton).otherwise(F.when(
            (low > -1e3) & (high < 1e3), (low + high) / 2).when(miss < 0, F.greatest(tilt * 2, F.lit(0.5)))
            .otherwise(F.least(tilt * 2, F.lit(-0.5))))
        solved = (F.abs(miss) <= TOLERANCE * F.col("target")) | (high - low < 1e-12)
        going = ~F.col("done")
        state = keep(joined.select(
            "source", "source_size", "target", "n", "cap", "mean", "full",
            F.when(going & ~solved, following).otherwise(tilt).alias("tilt"),
            F.when(going, low).otherwise(F.col("low")).alias("low"),
            F.when(going, high).otherwise(F.col("high")).alias("high"),
            (F.col("done") | F.coalesce(solved, F.lit(True))).alias("done")))
    return state


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, cell: int = CELL) -> DataFrame:
    """(key, source, size, source_size, target, copies) of every document; ``copies`` is 0, 1 or 2."""
    sized = keep(docs.select(F.col(ident(key)).alias("key"), F.col(ident(source)).cast("string").alias("source"),
                             words_of(F.col(ident(text))).alias("size")))
    groups = keep(sized.groupBy("source", "size").agg(F.count("*").alias("docs")))
    sources = groups.groupBy("source").agg(
        F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.sum("docs").alias("n"))
    goals = targets(sources.select("source", "source_size"), weights, share)
    goals = goals.join(sources.select(F.col("source").alias("of"), "n"), F.col("source").eqNullSafe(F.col("of"))) \
        .drop("of")
    state = tilts(groups, goals)

    tilted = groups.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))) \
        .select("source", "size", "docs", "source_size", "target",
                rate_of(F.col("tilt"), F.col("size"), F.col("mean"), F.col("full")).alias("rate"))
    given = keep(rounded(tilted)).select(
        F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target",
        F.col("docs").alias("all"), "give", F.ceil(F.col("docs") / cell).cast("int").alias("cells"))
    placed = sized.join(given, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("key"), "cells").cast("int"))

    # a group's copies are shared out to its cells by their running number of documents
    own = ["source", "size", "cell"]
    cells = placed.groupBy(*own).agg(F.count("*").alias("docs"), F.first("all").alias("all"),
                                     F.first("give").alias("give"))
    upto = F.sum("docs").over(Window.partitionBy("source", "size").orderBy("cell")
                              .rowsBetween(Window.unboundedPreceding, 0)).cast(DEC)

    def part(n: Column) -> Column:
        return F.floor((F.col("give").cast(DEC) * n / F.col("all")).cast("decimal(38,6)")).cast("long")

    dealt = cells.withColumn("upto", upto).select(
        *[F.col(c).alias(f"c_{c}") for c in own], F.col("docs").alias("cell_docs"),
        (part(F.col("upto")) - part(F.col("upto") - F.col("docs"))).alias("cell_give"))
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (
        F.col("cell") == F.col("c_cell"))
    turn = F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64(F.lit(1), "key"), "key"))
    base = F.floor(F.col("cell_give") / F.col("cell_docs"))
    copies = base + (F.col("turn") <= F.col("cell_give") - base * F.col("cell_docs")).cast("long")
    return (placed.withColumn("turn", turn).join(dealt, same)
            .select("key", "source", "size", "source_size", "target", copies.cast("long").alias("copies")))


def rounded(groups: DataFrame) -> DataFrame:
    """``give``: copies of each group of ``docs`` equal documents, from their ``rate``.

    The running sum of rates by size is rounded; what a source then lacks or has
    too much is made up with its shortest documents.  A source has at most as
    many groups as there are sizes.
    """
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    rates = (F.col("docs") * F.col("rate")).cast(DEC)

    def nearest(x: Column) -> Column:
        return F.floor((x + GRID // 2) / GRID).cast("long")

    first = groups.withColumn("upto", F.sum(rates).over(by_size))
    first = first.withColumn("give", nearest(F.col("upto")) - nearest(F.col("upto") - rates))
    miss = F.floor(F.col("target") + 0.5) - F.sum((F.col("give") * F.col("size")).cast(DEC)).over(whole)
    room = F.when(F.col("size") == 0, 0).when(F.col("miss") > 0, MOST * F.col("docs") - F.col("give")) \
        .otherwise(F.col("give"))
    second = first.withColumn("miss", miss.cast("long")).withColumn("room", room.cast("long"))
    before = F.sum((F.col("room") * F.col("size")).cast(DEC)).over(by_size) - F.col("room") * F.col("size")
    more = F.least("room", F.floor((F.abs("miss") - before) / F.greatest("size", F.lit(1))))
    change = F.greatest(F.lit(0), more).cast("long")
    return second.withColumn("give", (F.col("give") + F.signum("miss") * change).cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken; rows with the same id are told apart by number."""
    nth = F.row_number().over(Window.partitionBy("__id").orderBy("__source", "__size"))
    taken = (mix(docs).select(F.col("key").alias("__id"), F.col("source").alias("__source"),
                              F.col("size").alias("__size"), "copies")
             .withColumn("__n", nth).where(F.col("copies") > 0).select("__id", "__n", "copies"))
    own = docs.withColumns({"__id": F.col("doc_id"), "__source": F.col("source"), "__size": words_of(F.col("text"))})
    own = own.withColumn("__n", nth).withColumnRenamed("__id", "__own")
    joined = own.join(taken, F.col("__own").eqNullSafe(F.col("__id")) & (own["__n"] == taken["__n"]))
    return joined.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))) \
        .select(*[own[c] for c in docs.columns])


def op5_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = picked(table(spark, d, "documents"), "doc_id", "source", "text")
    return mix(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target",
                            (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op5_mix_sources": op5_mix_sources}
ORACLES: dict[str, str] = {}

"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.base import keep


#: Members of a large group whose pairs one task handles.
SHARE = 512


def spread(members: DataFrame, group: str, member: str) -> tuple[DataFrame, DataFrame]:
    """Two copies of ``members`` whose join on (``group``, ``share``) pairs each group's members as a join on
    ``group`` would, with a large group's pairs dealt to one share for every SHARE members of the first copy."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    sized = members.join(sizes, group)
    first = sized.withColumn("share", F.pmod(F.xxhash64(member), "shares").cast("int")).drop("shares")
    second = sized.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return first, second


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id each linked id can reach; links are (a, b) of longs, a <> b.

    Alternates two steps until nothing changes: every id points all its larger
    neighbours at the smallest one it sees, then all its smaller ones.  Both are
    one grouped minimum and one join, and the number of links never grows.
    """
    links = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    before = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # larger neighbours to the smallest of the neighbourhood and the id itself
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (both.where("b > a").join(lowest, "a").select(F.col("low").alias("a"), "b")
                 .where("a < b").distinct())
        # smaller neighbours, and the id, to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (large.join(low, "b").select(F.explode(F.array(
            F.struct(F.col("low").alias("a"), F.col("a").alias("b")),
            F.struct(F.col("low").alias("a"), F.col("b").alias("b")))).alias("x")).select("x.a", "x.b")
            .where("a < b").distinct())
        links = keep(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                        F.count_if(F.lit(True))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    found = links.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component")
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    return keep(found.union(roots))

"""Relationship evidence between columns, computed from the data.

Dependencies are decided by grouped minima and maxima or by counting distinct
pairs that were first grouped as pairs.  Both combine on the map side, so a key
that owns a third of all rows is reduced before it travels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.exprs import as_list, contains_any, inline_structs, q, ratio

By = str | Sequence[str] | None


def cardinality_band(profiles: DataFrame, low: int, high: int) -> DataFrame:
    """Columns whose distinct count lies in the band."""
    return profiles.where(F.col("distinct_count").between(low, high))


def cardinality_contrast(profiles: DataFrame, many: str, few: str,
                         factor: float = 2.0) -> DataFrame:
    """Whether column ``many`` has far more distinct values than ``few``."""
    counts = profiles.groupBy("sheet_id").agg(
        F.max(F.when(F.col("column") == many, F.col("distinct_count"))).alias("many_count"),
        F.max(F.when(F.col("column") == few, F.col("distinct_count"))).alias("few_count"),
    ).where(F.col("many_count").isNotNull() & F.col("few_count").isNotNull())
    share = ratio(F.col("many_count"), F.col("few_count"))
    return counts.select(
        "sheet_id", "many_count", "few_count", share.alias("ratio"),
        F.coalesce(share >= factor, F.lit(False)).alias("contrasts"),
    )


def key_grain(df: DataFrame, key: str, detail: str, by: By = None) -> DataFrame:
    """Rows, distinct keys and distinct key+detail pairs, and what a row is.

    Pairs are grouped first, so keys are counted from pairs, not from rows.
    """
    keys = as_list(by)
    outer = [q(k) for k in keys]
    pairs = df.groupBy(*outer, q(key).alias("__k"), q(detail).alias("__d")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    per_key = pairs.groupBy(*outer, "__k").agg(
        F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__pairs")
    )
    grain = per_key.groupBy(*outer).agg(
        F.sum("__n").alias("row_count"),
        F.count(F.lit(1)).alias("key_count"),
        F.sum("__pairs").alias("pair_count"),
    )
    return grain.withColumn(
        "grain",
        F.when(F.col("key_count") == F.col("row_count"), "key")
        .when(F.col("pair_count") == F.col("row_count"), "key+detail")
        .otherwise("none"),
    )


def date_order(df: DataFrame, early: str, late: str, low: int = 0, high: int = 3,
               by: By = None) -> DataFrame:
    """How often ``early`` comes first, and how often the gap is in days ``low..high``."""
    gap = F.datediff(q(late), q(early))
    return df.groupBy(*[q(k) for k in as_list(by)]).agg(
        F.count(gap).alias("pairs"),
        F.count_if(gap >= 0).alias("ordered"),
        F.count_if(gap.between(low, high)).alias("in_gap"),
    )


def exclude_by_token(candidates: DataFrame, tokens: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drops candidates of a standard field whose name holds a barred token."""
    name = F.lower("column")
    bad = F.lit(False)
    for std, words in tokens.items():
        bad = bad | ((F.col("std_field") == std) & contains_any(name, list(words)))
    return candidates.where(~bad)


def prefer_code(candidates: DataFrame,
                words: Sequence[str] = ("编号", "编码", "代码", "code", "id", "key")) -> DataFrame:
    """Ranks candidates of a field: code-like names first, then score, then position."""
    coded = contains_any(F.lower("column"), list(words))
    order = W.partitionBy("sheet_id", "std_field").orderBy(
        F.desc("is_code"), F.desc("score"), "col_pos"
    )
    return candidates.withColumn("is_code", coded).withColumn(
        "rank", F.row_number().over(order)
    )


def _fanouts(df: DataFrame, a: str, b: str, by: By) -> DataFrame:
    """Largest number of b per a and of a per b, from distinct pairs only.

    One shuffle for the pairs; each side is then counted from pairs, which a
    hot value enters already reduced to one row per partner.
    """
    keys = as_list(by)
    outer = [q(k) for k in keys]
    pairs = df.where(q(a).isNotNull() & q(b).isNotNull()).select(
        *outer, q(a).cast("string").alias("__a"), q(b).cast("string").alias("__b")
    ).distinct()
    sides = pairs.select(
        *outer,
        F.inline(F.array(
            F.struct(F.lit("a").alias("__side"), F.col("__a").alias("__v")),
            F.struct(F.lit("b").alias("__side"), F.col("__b").alias("__v")),
        )),
    )
    degree = sides.groupBy(*outer, "__side", "__v").agg(F.count(F.lit(1)).alias("__n"))
    return degree.groupBy(*outer).agg(
        F.max(F.when(F.col("__side") == "a", F.col("__n"))).alias("max_b_per_a"),
        F.max(F.when(F.col("__side") == "b", F.col("__n"))).alias("max_a_per_b"),
    )


#: rows a task holds at once, and the share of all rows from which a value is too frequent for one task
ROWS_PER_TASK = 250_000
FREQUENT = 0.001


def _frequent(keys: DataFrame, column: str) -> list[int]:
    """Values (64-bit hashes, none NULL) that hold more than ``FREQUENT`` of all rows, and maybe some that hold less."""
    row = keys.stat.freqItems([column], FREQUENT).first()
    maybe = list(row[0] or []) if row else []
    if not maybe:
        return []
    counted = keys.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    often = keys.where(q(column).isin(maybe)).groupBy(q(column)).agg(F.count(F.lit(1)).alias("__n"))
    return [r[0] for r in often.where(F.col("__n") >= max(2.0, counted * FREQUENT / 2)).collect()]


def _tasks(df: DataFrame) -> int:
    """As many tasks as keep each at ``ROWS_PER_TASK``, however long the table."""
    return max(df.count() // ROWS_PER_TASK + 1, df.sparkSession.sparkContext.defaultParallelism)


def _fanouts_within(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """``_fanouts`` for many groups: each is counted where its rows are, in tasks of bounded size.

    Groups that hold a large share of the rows are left to ``_fanouts``, which spreads them by value.
    """
    text = [F.xxhash64(q(c).cast("string")).alias(c) for c in (a, b)]
    rows = df.where(q(a).isNotNull() & q(b).isNotNull()).select(q(group).alias("__g"), *text)
    mark = F.xxhash64("__g")
    hot = _frequent(rows.select(mark.alias("__k")), "__k")
    near = rows.where(~mark.isin(hot)) if hot else rows
    found = _fanouts(near.repartition(_tasks(rows), "__g"), a, b, "__g")
    if hot:
        found = found.unionByName(_fanouts(rows.where(mark.isin(hot)), a, b, "__g"))
    return found.withColumnRenamed("__g", group)


def bijection(df: DataFrame, a: str, b: str, by: By = None) -> DataFrame:
    """Whether values of ``a`` and ``b`` pair off one to one."""
    return _fanouts(df, a, b, by).withColumn(
        "one_to_one", (F.col("max_b_per_a") == 1) & (F.col("max_a_per_b") == 1)
    )


def relation_kind(df: DataFrame, a: str, b: str, by: By = None) -> DataFrame:
    """1:1, N:1, 1:N or N:M from ``a`` to ``b``."""
    many_b, many_a = F.col("max_b_per_a") > 1, F.col("max_a_per_b") > 1
    return _fanouts(df, a, b, by).withColumn(
        "relation",
        F.when(many_a & many_b, "N:M").when(many_a, "N:1").when(many_b, "1:N").otherwise("1:1"),
    )


#: distinct values from which a column's rows are put together by its values
WIDE = 20_000


def relation_matrix(df: DataFrame, columns: Sequence[str], by: By = None, wide: int = WIDE) -> DataFrame:
    """Relation of every pair of columns, as ``relation_kind`` gives it, from one job.

    Values travel as 64-bit hashes.  The rows of a column of ``wide`` or more values are put together by its values,
    all partners in one row: distinct partners are counted there, and only their counts travel on.  Pairs of other
    columns, and values too frequent for one task, become one row per pair; distinct pairs are few there or spread over
    all tasks.  Rows in which a value of the pair is NULL don't count for it.  A pair without rows is left out.
    """
    keys = as_list(by)
    outer = [q(k) for k in keys]
    k = len(columns)
    hashed = df.select(*outer, *[F.when(q(c).isNotNull(), F.xxhash64(q(c))).alias(f"__{i}") for i, c in enumerate(columns)])
    sizes = hashed.agg(*[F.approx_count_distinct(f"__{i}").alias(f"__{i}") for i in range(k)]).first()
    order = sorted(range(k), key=lambda i: -sizes[i])  # partners of a column have no more values than it has
    bases = [i for i in order if sizes[i] >= wide]
    tasks = _tasks(hashed) if bases else 0

    def pair(i: int, j: int) -> Column:
        return F.lit(min(i, j) * k + max(i, j)).alias("__p")

    def once(i: int, j: int) -> Column:
        return F.transform(f"__s{j}", lambda v: F.struct(
            pair(i, j), F.lit(i > j).alias("__of_a"), v.alias("__v"), F.lit(1).cast("long").alias("__n")))

    parts, spread = [], []
    for at, i in enumerate(order):
        partners = order[at + 1:]
        if not partners:
            continue
        value = F.col(f"__{i}")
        if i in bases:
            hot = _frequent(hashed.where(value.isNotNull()).select(value.alias("__k")), "__k")
            rest = value.isNotNull() & ~value.isin(hot) if hot else value.isNotNull()
            lists = hashed.where(rest).repartition(tasks, *outer, value).groupBy(*outer, value).agg(
                F.collect_list(F.struct(*[F.col(f"__{j}") for j in partners])).alias("__l"))
            sets = lists.select(*outer, *[F.array_distinct(F.filter(
                F.col("__l").getField(f"__{j}"), lambda v: v.isNotNull())).alias(f"__s{j}") for j in partners])
            own = [F.struct(pair(i, j), F.lit(i < j).alias("__of_a"), F.lit(None).cast("long").alias("__v"),
                            F.size(f"__s{j}").cast("long").alias("__n")) for j in partners]
            others = [once(i, j) for j in partners]
            parts.append(sets.select(*outer, F.inline(F.concat(F.array(*own), *others))).where("__n > 0"))
            if not hot:
                continue
            value = F.when(value.isin(hot), value)
        spread += [F.struct(pair(i, j), (value if i < j else F.col(f"__{j}")).alias("__a"),
                            (F.col(f"__{j}") if i < j else value).alias("__b")) for j in partners]
    if spread:
        distinct = hashed.select(*outer, inline_structs(spread)).where("__a IS NOT NULL AND __b IS NOT NULL").distinct()
        parts.append(distinct.select(*outer, "__p", F.inline(F.array(
            F.struct(F.lit(True).alias("__of_a"), F.col("__a").alias("__v"), F.lit(1).cast("long").alias("__n")),
            F.struct(F.lit(False).alias("__of_a"), F.col("__b").alias("__v"), F.lit(1).cast("long").alias("__n"))))))
    # a count that is complete has no value; the others are summed
    degree = reduce(DataFrame.unionByName, parts).groupBy(*outer, "__p", "__of_a", "__v").agg(
        F.sum("__n").alias("__sum"), F.max("__n").alias("__max"))
    count = F.when(F.col("__v").isNull(), F.col("__max")).otherwise(F.col("__sum"))
    most = degree.groupBy(*outer, "__p").agg(F.max(F.when(F.col("__of_a"), count)).alias("max_b_per_a"),
                                             F.max(F.when(~F.col("__of_a"), count)).alias("max_a_per_b"))
    names = F.array(*[F.lit(c) for c in columns])
    many_b, many_a = F.col("max_b_per_a") > 1, F.col("max_a_per_b") > 1
    return most.select(*outer, F.get(names, F.floor(F.col("__p") / k).cast("int")).alias("a"), F.get(names, F.col("__p") % k).alias("b"),
                       "max_b_per_a", "max_a_per_b",
                       F.when(many_a & many_b, "N:M").when(many_a, "N:1").when(many_b, "1:N").otherwise("1:1").alias("relation"))


def functional_dependency(df: DataFrame, lhs: str, rhs: Sequence[str], by: By = None) -> DataFrame:
    """Groups of ``lhs`` in which a dependent column takes several values.

    A group holds one value exactly when minimum and maximum agree, so no
    distinct aggregate is needed and all dependents share one pass.  Texts are
    compared by a 64-bit hash: numbers are aggregated in hash tables, while the
    least of texts would need all rows sorted.
    """
    keys = as_list(by)
    outer = [q(k) for k in keys]

    def value(c: str) -> Column:
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        return F.when(q(c).isNotNull(), F.xxhash64(q(c))) if is_text else q(c)

    groups = df.where(q(lhs).isNotNull()).groupBy(*outer, q(lhs).alias("__l")).agg(
        *[(F.min(value(c)) != F.max(value(c))).alias(f"__v{i}") for i, c in enumerate(rhs)]
    )
    totals = groups.groupBy(*outer).agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.count_if(F.col(f"__v{i}")).alias(f"__v{i}") for i in range(len(rhs))],
    )
    rows = [
        F.struct(F.lit(c).alias("dependent"), F.col(f"__v{i}").alias("violating_groups"))
        for i, c in enumerate(rhs)
    ]
    return totals.select(*outer, "groups", inline_structs(rows)).withColumn(
        "holds", F.col("violating_groups") == 0
    )


def dependency_violations(df: DataFrame, lhs: str, rhs: str, by: By = None) -> DataFrame:
    """The violating groups themselves, with the two ends of the spread."""
    keys = as_list(by)
    groups = df.where(q(lhs).isNotNull()).groupBy(*[q(k) for k in keys], q(lhs)).agg(
        F.min(q(rhs)).alias("low"), F.max(q(rhs)).alias("high"),
        F.count(F.lit(1)).alias("rows"),
    )
    return groups.where(F.col("low") != F.col("high"))


def sequence_consistency(df: DataFrame, group: str, place: str, seq: str) -> DataFrame:
    """Within a group: same place means same sequence number, and back."""
    flags = _fanouts_within(df, place, seq, group)
    return flags.withColumn(
        "consistent", (F.col("max_b_per_a") == 1) & (F.col("max_a_per_b") == 1)
    )


def co_zero(df: DataFrame, a: str, b: str, by: By = None) -> DataFrame:
    """Rows where both quantities are zero."""
    return df.groupBy(*[q(k) for k in as_list(by)]).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if((q(a) == 0) & (q(b) == 0)).alias("both_zero"),
    ).withColumn("share", ratio(F.col("both_zero"), F.col("row_count")))


def rank_quantity_candidates(stats: DataFrame) -> DataFrame:
    """Numeric columns of a sheet: low null rate first, then high variation.

    ``stats``: sheet_id, column, position, null_rate, mean, std.
    """
    cv = F.abs(ratio(F.col("std"), F.col("mean")))
    order = W.partitionBy("sheet_id").orderBy(
        "null_rate", F.desc_nulls_last("variation"), "position"
    )
    return stats.where(F.col("mean").isNotNull()).withColumn("variation", cv).withColumn(
        "rank", F.row_number().over(order)
    )


# Unit spellings by dimension, and the standard unit of each.
VOLUME_UNITS = ("m3", "m³", "cbm", "立方米", "立方", "l", "liter", "升", "cm3", "ft3")
WEIGHT_UNITS = ("kg", "公斤", "千克", "吨", "ton", "lb", "磅", "斤", "g")
STANDARD_UNITS = ("m3", "m³", "cbm", "立方米", "立方", "kg", "公斤", "千克")


def unit_reminders(mapping: DataFrame, volume: str = "体积", weight: str = "重量") -> DataFrame:
    """Unit named in the mapped volume or weight column, and whether to convert."""
    name = F.lower("column")
    inside = F.regexp_extract(
        name, r"(?:[(（\[_ -])([a-z]+3?|m³|[一-龥]+)[)）\]]?$", 1
    )
    rows = mapping.where(
        F.col("column").isNotNull() & F.col("std_field").isin(volume, weight)
    )
    known = F.when(F.col("std_field") == volume, inside.isin(*VOLUME_UNITS)).otherwise(
        inside.isin(*WEIGHT_UNITS)
    )
    unit = F.when(known, inside)
    return rows.select(
        "sheet_id", "std_field", "column", unit.alias("unit"),
        F.when(unit.isNull(), "unknown")
        .when(unit.isin(*STANDARD_UNITS), "ok")
        .otherwise("convert").alias("reminder"),
    )


def pattern_share(df: DataFrame, column: str, pattern: str, by: By = None) -> DataFrame:
    """Share of non-null values that match the pattern."""
    hit = q(column).rlike(pattern)
    return df.groupBy(*[q(k) for k in as_list(by)]).agg(
        F.count(q(column)).alias("filled"),
        F.count_if(hit).alias("matching"),
    ).withColumn("share", ratio(F.col("matching"), F.col("filled")))


def key_candidates(profiles: DataFrame) -> DataFrame:
    """Columns without nulls, most unique first, leftmost on ties."""
    order = W.partitionBy("sheet_id").orderBy(F.desc("uniqueness"), "position")
    return profiles.where(F.col("null_rate") == 0).withColumn(
        "rank", F.row_number().over(order)
    )

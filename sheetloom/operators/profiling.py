"""Column profiling: nulls, uniqueness, types, statistics, consistency.

Two physical shapes are used.  Everything that is a plain aggregate is computed
in **one wide pass** over the typed frame (map-side combined, one small shuffle
on the grouping keys) and then turned to one row per column with ``inline``.
Only exact distinct counts and mixed-kind metrics go through long rows, where
``(group, column, value)`` is aggregated first so that a hot group is spread
over many tasks before anything is gathered per group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.exprs import (
    KINDS,
    as_list,
    count_true,
    data_columns,
    half_up,
    ident,
    inline_structs,
    is_float,
    is_missing,
    is_number,
    join_on,
    literal,
    q,
    ratio,
    schema_kind,
)

from sheetloom.plans.lineage import materialize

By = str | Sequence[str] | None


# ------------------------------------------------------------------ wide pass


def _wide_to_long(
    df: DataFrame,
    by: list[str],
    columns: list[str],
    metrics: Callable[[str, T.DataType], dict[str, Column]],
) -> DataFrame:
    """One aggregate over all columns, then one row per (group, column)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    names: list[str] = []
    for i, c in enumerate(columns):
        exprs = metrics(c, df.schema[c].dataType)
        names = list(exprs)
        aggs += [e.alias(f"__{i}_{m}") for m, e in exprs.items()]
    wide = df.groupBy(*[q(k) for k in by]).agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(i).alias("position"),
            F.col("__n").alias("total_rows"),
            *[F.col(f"__{i}_{m}").alias(m) for m in names],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(*[q(k) for k in by], inline_structs(rows))


def _present(c: str, dtype: T.DataType, nulls: str) -> Column:
    return ~is_missing(q(c), dtype, nulls)


def null_profile(df: DataFrame, by: By = None, nulls: str = "blank",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Null count, rate and percentage (2 dp) per column."""
    keys = as_list(by)
    cols = data_columns(df, keys, columns)
    long = _wide_to_long(
        df, keys, cols, lambda c, t: {"non_null": count_true(_present(c, t, nulls))}
    )
    missing = F.col("total_rows") - F.col("non_null")
    rate = ratio(missing, F.col("total_rows"))
    return long.select(
        *[q(k) for k in keys], "column", "position", "total_rows", "non_null",
        missing.alias("null_count"), rate.alias("null_rate"),
        half_up(rate * 100, 2).alias("null_percentage"),
    )


def _family(dtype: T.DataType) -> str:
    """Type in which the values of a column are compared."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return "double" if is_float(dtype) else "string"


def _typed(c: str, family: str) -> str:
    """SQL text of a column in its family type, NaN as NULL."""
    name = ident(c)
    if family == "double":
        return f"CASE WHEN NOT isnan({name}) THEN CAST({name} AS double) END AS {name}"
    return f"CAST({name} AS {family}) AS {name}"


def _value_groups(df: DataFrame, by: list[str], columns: list[str], nulls: str) -> DataFrame:
    """(keys, column, n, flags): one row per distinct value of every column.

    Grouping on the value spreads the shuffle, so one hot group never lands in
    one task.  Columns are stacked per type family: values keep their native
    form and each family reads only its own columns, so together they read the
    data once.
    """
    keys = [q(k) for k in by]
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(df.schema[c].dataType), []).append(c)
    parts = []
    key_names = [ident(k) for k in by]
    for family, names in families.items():
        groups = df.selectExpr(*key_names, *[_typed(c, family) for c in names]).unpivot(
            keys, [q(c) for c in names], "column", "value"
        ).groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))
        there, text = "value IS NOT NULL", family == "string"
        filled = f"{there} AND value <> ''" if text and nulls == "blank" else there
        ten = "coalesce(length(value) = 10, false)" if text else "false"
        parts.append(groups.selectExpr(
            *key_names, "column", "n", f"{there} AS there", f"{filled} AS filled", f"{ten} AS ten"
        ))
    return reduce(DataFrame.unionByName, parts)


def _fold_groups(groups: DataFrame, keys: list[Column]) -> DataFrame:
    return groups.groupBy(*keys).agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(F.col("filled"), F.col("n")).otherwise(0)).alias("non_null"),
        F.count_if("filled").alias("distinct_count"),
        F.sum(F.when(F.col("there"), F.col("n")).otherwise(0)).alias("valued"),
        F.sum(F.when(F.col("ten"), F.col("n")).otherwise(0)).alias("ten_long"),
    )


def _value_counts(df: DataFrame, by: list[str], columns: list[str], nulls: str) -> DataFrame:
    """Row, value and exact distinct counts per (group, column)."""
    groups = _value_groups(df, by, columns, nulls)
    return _fold_groups(groups, [*[q(k) for k in by], F.col("column")]).withColumn(
        "position", _lookup(columns, range(len(columns)), F.col("column"))
    )


def _lookup(names: Sequence[str], values: Sequence, key: Column) -> Column:
    """Literal value (SQL text) by name, from one map literal."""
    pairs = ", ".join(f"{literal(n)}, {v}" for n, v in zip(names, values))
    return F.element_at(F.expr(f"map({pairs})"), key)


def _sketched(c: str, present: Column) -> Column:
    """Distinct count by a mergeable sketch of value hashes (about 1.6 % error)."""
    sketch = F.hll_sketch_agg(F.when(present, F.xxhash64(q(c))))
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0).cast("long"))


def _counts(df: DataFrame, by: list[str], columns: list[str], nulls: str,
            exact: bool) -> DataFrame:
    """Counts of ``_value_counts`` with column names, exact or by sketch."""
    if exact:
        return _value_counts(df, by, columns, nulls)

    def metrics(c: str, t: T.DataType) -> dict[str, Column]:
        present, text = _present(c, t, nulls), q(c).cast("string")
        return {
            "non_null": count_true(present),
            "distinct_count": _sketched(c, present),
            "valued": count_true(_present(c, t, "strict")),
            "ten_long": count_true(F.length(text) == 10),
        }

    return _wide_to_long(df, by, columns, metrics)


def uniqueness(df: DataFrame, by: By = None, nulls: str = "blank", exact: bool = True,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values over total rows.

    ``exact=False`` uses a sketch in one wide pass without the value shuffle.
    """
    keys = as_list(by)
    cols = data_columns(df, keys, columns)
    return _counts(df, keys, cols, nulls, exact).select(
        *[q(k) for k in keys], "column", "position", "total_rows", "non_null", "distinct_count",
        ratio(F.col("distinct_count"), F.col("total_rows")).alias("uniqueness"),
    )


def duplication_rate(df: DataFrame, by: By = None, nulls: str = "blank", exact: bool = True,
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null values that repeat an earlier one."""
    keys = as_list(by)
    base = uniqueness(df, by, nulls, exact, columns)
    return base.select(
        *[q(k) for k in keys], "column", "position", "non_null", "distinct_count",
        (F.lit(1.0) - ratio(F.col("distinct_count"), F.col("non_null"))).alias("duplication_rate"),
    )


def _numeric_metrics(c: str, dtype: T.DataType) -> dict[str, Column]:
    """min, max, mean and sample deviation; NULL for columns that are not numbers."""
    if not is_number(dtype):
        nothing = F.max(F.lit(None).cast("double"))
        return {"min": nothing, "max": nothing, "mean": nothing, "std": nothing}
    value = q(c).cast("double")
    if is_float(dtype):
        value = F.when(~F.isnan(q(c)), value)
    return {"min": F.min(value), "max": F.max(value), "mean": F.avg(value),
            "std": F.stddev_samp(value)}


def numeric_stats(df: DataFrame, by: By = None, columns: Sequence[str] | None = None) -> DataFrame:
    keys = as_list(by)
    cols = [c for c in data_columns(df, keys, columns) if is_number(df.schema[c].dataType)]
    long = _wide_to_long(df, keys, cols, _numeric_metrics)
    return long.select(*[q(k) for k in keys], "column", "position", "min", "max", "mean", "std")


def _byte_size(c: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.sum(F.coalesce(F.octet_length(q(c)), F.lit(0)).cast("long"))
    if isinstance(dtype, T.BooleanType):
        width = 1
    elif isinstance(dtype, (T.IntegerType, T.FloatType, T.DateType)):
        width = 4
    elif isinstance(dtype, T.ShortType):
        width = 2
    elif isinstance(dtype, T.ByteType):
        width = 1
    else:
        width = 8
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.sum(F.coalesce(F.octet_length(F.to_json(q(c))), F.lit(0)).cast("long"))
    return F.sum(F.when(q(c).isNotNull(), F.lit(width)).otherwise(0).cast("long"))


def basic_stats(df: DataFrame, by: By = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, columns, declared type and value bytes per column."""
    keys = as_list(by)
    cols = data_columns(df, keys, columns)
    long = _wide_to_long(df, keys, cols, lambda c, t: {"value_bytes": _byte_size(c, t)})
    types = [literal(f.dataType.simpleString()) for f in df.select(*[q(c) for c in cols]).schema]
    return long.select(
        *[q(k) for k in keys], "column", "position", "total_rows",
        F.lit(len(cols)).alias("total_columns"),
        _lookup(cols, types, F.col("column")).alias("declared_type"),
        F.coalesce("value_bytes", F.lit(0)).alias("value_bytes"),
    )


def quality_metrics(df: DataFrame, by: By = None, exact: bool = True,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls (strict), distinct counts, type and numeric statistics per column."""
    keys = as_list(by)
    cols = data_columns(df, keys, columns)

    def metrics(c: str, t: T.DataType) -> dict[str, Column]:
        present = _present(c, t, "strict")
        found = {"non_null": count_true(present), **_numeric_metrics(c, t)}
        if not exact:
            found["distinct_count"] = _sketched(c, present)
        return found

    long = _wide_to_long(df, keys, cols, metrics)
    if exact:
        counts = _value_counts(df, keys, cols, "strict").select(
            *[q(k) for k in keys], "column", "distinct_count"
        )
        long = join_on(long, counts, [*keys, "column"], "left")
    missing = F.col("total_rows") - F.col("non_null")
    types = [literal(f.dataType.simpleString()) for f in df.select(*[q(c) for c in cols]).schema]
    return long.select(
        *[q(k) for k in keys], "column", "position", "total_rows",
        missing.alias("null_count"),
        half_up(ratio(missing, F.col("total_rows")) * 100, 2).alias("null_percentage"),
        F.col("distinct_count").alias("unique_count"),
        half_up(ratio(F.col("distinct_count"), F.col("total_rows")) * 100, 2)
        .alias("unique_percentage"),
        _lookup(cols, types, F.col("column")).alias("data_type"),
        "min", "max", "mean", "std",
    )


# ---------------------------------------------------------------- completeness


def _present_count(df: DataFrame, cols: list[str], nulls: str) -> Column:
    parts = [_present(c, df.schema[c].dataType, nulls).cast("int") for c in cols]
    return reduce(lambda a, b: a + b, parts)


def completeness_overall(df: DataFrame, by: By = None, nulls: str = "strict",
                         columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null cells over all cells, in percent (2 dp)."""
    keys = as_list(by)
    cols = data_columns(df, keys, columns)
    counted = df.groupBy(*[q(k) for k in keys]).agg(
        F.coalesce(F.sum(_present_count(df, cols, nulls).cast("long")), F.lit(0)).alias("filled"),
        (F.count(F.lit(1)) * F.lit(len(cols))).alias("cells"),
    )
    return counted.select(
        *[q(k) for k in keys], "filled", "cells",
        half_up(ratio(F.col("filled"), F.col("cells")) * 100, 2).alias("overall"),
    )


def completeness_rows(df: DataFrame, by: By = None, nulls: str = "strict",
                      columns: Sequence[str] | None = None) -> DataFrame:
    """Row completeness in percent (2 dp), then min, max, mean, population std."""
    keys = as_list(by)
    cols = data_columns(df, keys, columns)
    pct = half_up(
        _present_count(df, cols, nulls).cast("double") / F.lit(float(len(cols))) * 100, 2
    )
    rows = df.select(*[q(k) for k in keys], pct.alias("__pct"))
    return rows.groupBy(*[q(k) for k in keys]).agg(
        F.min("__pct").alias("min"),
        F.max("__pct").alias("max"),
        half_up(F.avg("__pct"), 2).alias("mean"),
        half_up(F.stddev_pop("__pct"), 2).alias("std"),
    )


def completeness_columns(df: DataFrame, by: By = None, nulls: str = "strict",
                         columns: Sequence[str] | None = None) -> DataFrame:
    keys = as_list(by)
    base = null_profile(df, by, nulls, columns)
    return base.select(
        *[q(k) for k in keys], "column", "position",
        half_up(ratio(F.col("non_null"), F.col("total_rows")) * 100, 2).alias("completeness"),
    )


# -------------------------------------------------------------- cells: by kind

CELL_KEYS = ("sheet_id", "column")


def _kind_code() -> Column:
    """Kind as a small number: fixed-width buffers keep the aggregate hashed."""
    code = F
    for i, k in enumerate(KINDS):
        code = code.when(F.col("kind") == k, F.lit(i))
    return code.otherwise(F.lit(len(KINDS) - 1))


def kind_counts() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(f"__k{i}") for i, k in enumerate(KINDS)]


def kind_list() -> Column:
    """Sorted kinds of value present, from the counts of ``kind_counts``."""
    named = [(k, i) for i, k in enumerate(KINDS) if k != "null"]
    return F.array_compact(F.array(
        *[F.when(F.col(f"__k{i}") > 0, F.lit(k)) for k, i in sorted(named)]
    ))


def _share_of_first() -> Column:
    """Share of cells with the kind of the first one, after ``kind_counts``."""
    same = F.get(F.array(*[F.col(f"__k{i}") for i in range(len(KINDS))]), F.col("__first"))
    return ratio(same, sum((F.col(f"__k{i}") for i in range(1, len(KINDS))), F.col("__k0")))


def infer_column_type(cells: DataFrame) -> DataFrame:
    """``numeric``, ``date`` (all texts of length 10) or ``text`` per column.

    A column without values is ``text``; booleans are not numbers.
    """
    present = F.col("kind") != "null"
    grouped = cells.groupBy(*CELL_KEYS).agg(
        F.count_if(present).alias("non_null"),
        F.count_if(F.col("kind").isin("int", "float")).alias("numbers"),
        F.count_if((F.col("kind") == "text") & (F.length("raw") == 10)).alias("ten_long"),
    )
    return grouped.select(*CELL_KEYS, "non_null", column_type(
        F.col("non_null"), F.col("numbers"), F.col("ten_long")).alias("data_type"))


def column_type(non_null: Column, numbers: Column, ten_long: Column) -> Column:
    return (
        F.when(non_null == 0, "text")
        .when(numbers == non_null, "numeric")
        .when(ten_long == non_null, "date")
        .otherwise("text")
    )


def type_consistency(cells: DataFrame, rounded: bool = True) -> DataFrame:
    """Share of cells (nulls included) with the kind of the first cell (3 dp).

    One aggregate: the first kind and the count of every kind travel together.
    """
    counted = cells.groupBy(*CELL_KEYS).agg(
        F.min_by(_kind_code(), "row_no").alias("__first"), *kind_counts()
    )
    share = _share_of_first()
    return counted.select(
        *CELL_KEYS,
        F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("__first")).alias("first_kind"),
        (half_up(share, 3) if rounded else share).alias("type_consistency"),
    )


def _format_share(lengths: Column) -> Column:
    spread = F.var_pop(lengths) / (F.avg(lengths) + F.lit(1.0))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + spread), F.lit(1.0))


def format_consistency(df: DataFrame, by: By = None, columns: Sequence[str] | None = None,
                       rounded: bool = True) -> DataFrame:
    """``1 / (1 + var(len) / (avg(len) + 1))`` for text columns, 1.0 otherwise (3 dp)."""
    keys = as_list(by)
    cols = data_columns(df, keys, columns)

    def metrics(c: str, t: T.DataType) -> dict[str, Column]:
        if isinstance(t, T.StringType):
            return {"format_consistency": _format_share(F.length(q(c)).cast("double"))}
        return {"format_consistency": F.coalesce(F.max(F.lit(1.0)), F.lit(1.0))}

    long = _wide_to_long(df, keys, cols, metrics)
    value = F.col("format_consistency")
    return long.select(
        *[q(k) for k in keys], "column", "position",
        (half_up(value, 3) if rounded else value).alias("format_consistency"),
    )


def consistency(cells: DataFrame) -> DataFrame:
    """Type consistency, format consistency and their mean, in one aggregate.

    Format consistency looks at text columns: a column holding at least one
    text (or boolean) cell; pure number columns keep 1.0.
    """
    lengths = F.when(F.col("kind") != "null", F.length("raw").cast("double"))
    counted = cells.groupBy(*CELL_KEYS).agg(
        F.min_by(_kind_code(), "row_no").alias("__first"), *kind_counts(),
        _format_share(lengths).alias("__even"),
    )
    texts = F.col(f"__k{KINDS.index('text')}") + F.col(f"__k{KINDS.index('bool')}")
    grouped = counted.select(
        *CELL_KEYS, _share_of_first().alias("__type"),
        F.when(texts > 0, F.col("__even")).otherwise(F.lit(1.0)).alias("__format"),
    )
    return grouped.select(
        *CELL_KEYS,
        half_up(F.col("__type"), 3).alias("type_consistency"),
        half_up(F.col("__format"), 3).alias("format_consistency"),
        half_up((F.col("__type") + F.col("__format")) / 2, 3).alias("overall_consistency"),
    )


def mixed_types(cells: DataFrame) -> DataFrame:
    """Columns holding more than one kind of value, with the sorted kinds."""
    grouped = cells.groupBy(*CELL_KEYS).agg(*kind_counts())
    return grouped.select(*CELL_KEYS, kind_list().alias("kinds")).where(F.size("kinds") > 1)


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Columns with at least one number."""
    grouped = cells.groupBy(*CELL_KEYS).agg(
        F.count_if(F.col("kind").isin("int", "float")).alias("numbers")
    )
    return grouped.where(F.col("numbers") > 0)


def integer_share(cells: DataFrame) -> DataFrame:
    """Share of whole numbers among the numbers of each column."""
    value = F.when(F.col("kind").isin("int", "float"), F.col("raw").try_cast("double"))
    grouped = cells.groupBy(*CELL_KEYS).agg(
        F.count(value).alias("numbers"),
        F.count_if(value == F.floor(value)).alias("whole"),
    )
    return grouped.where(F.col("numbers") > 0).select(
        *CELL_KEYS, "numbers", "whole",
        ratio(F.col("whole"), F.col("numbers")).alias("integer_share"),
    )


# ------------------------------------------------------------------- outliers


def outliers_3sigma(df: DataFrame, row_id: str, by: By = None,
                    columns: Sequence[str] | None = None, k: float = 3.0,
                    cut: bool = True) -> DataFrame:
    """Cells further than ``k`` population deviations from their column mean.

    Statistics are one small row per group.  Without groups they enter as a
    scalar subquery.  With groups they are written once (``cut``), so their
    true size decides between a broadcast, which leaves the rows where they
    are, and a shuffle join whose hot groups the adaptive skew join splits.
    """
    keys = as_list(by)
    cols = [c for c in data_columns(df, [*keys, row_id], columns)
            if is_number(df.schema[c].dataType)]
    value = {c: F.when(~is_missing(q(c), df.schema[c].dataType, "strict"), q(c).cast("double"))
             for c in cols}
    stats = df.groupBy(*[q(x) for x in keys]).agg(
        *[F.avg(value[c]).alias(f"__m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(value[c]).alias(f"__s{i}") for i, c in enumerate(cols)],
    )
    rows = df.select(*[q(x) for x in keys], q(row_id), *[q(c) for c in cols])
    if keys:
        joined = join_on(rows, materialize(stats) if cut else stats, keys)
    else:
        whole = stats.select(F.struct("*").alias("__s")).scalar()
        joined = rows.withColumn("__stats", whole).select("*", "__stats.*")
    flagged = [
        F.struct(
            F.lit(c).alias("column"),
            value[c].alias("value"),
            F.col(f"__m{i}").alias("mean"),
            F.col(f"__s{i}").alias("std"),
            (F.abs(value[c] - F.col(f"__m{i}")) > F.lit(float(k)) * F.col(f"__s{i}")).alias("far"),
        )
        for i, c in enumerate(cols)
    ]
    long = joined.select(*[q(x) for x in keys], q(row_id), inline_structs(flagged))
    return long.where(F.col("far")).drop("far")


def outlier_samples(outliers: DataFrame, row_id: str, by: By = None, n: int = 5) -> DataFrame:
    """First ``n`` outliers of each column in row order (a report excerpt)."""
    from pyspark.sql import Window as W

    keys = as_list(by)
    order = W.partitionBy(*[q(x) for x in keys], "column").orderBy(q(row_id))
    ranked = outliers.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)


# ------------------------------------------------------------------- profiles


PROFILE_COLUMNS = ("sheet_id", "column", "position", "total_rows", "non_null", "null_rate",
                   "distinct_count", "uniqueness", "data_type")


def profile_columns(df: DataFrame, by: str | None = None, sheet: str = "sheet",
                    nulls: str = "blank", exact: bool = True,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Profiles of a typed frame: one row per (sheet, column).

    ``by`` names the column that holds the sheet id; without it the whole frame
    is the sheet called ``sheet``.
    """
    named = df.withColumnRenamed(by, "sheet_id") if by else df.withColumn("sheet_id", F.lit(sheet))
    cols = data_columns(named, ["sheet_id"], columns)
    return profile_corpus([named.select("sheet_id", *[q(c) for c in cols])], nulls, exact)


def profile_corpus(frames: Sequence[DataFrame], nulls: str = "blank",
                   exact: bool = True) -> DataFrame:
    """Profiles of several typed frames that each carry ``sheet_id``.

    Distinct values are grouped frame by frame and folded together at the end,
    in one exchange for the whole corpus.
    """
    parts, names, places, numbers, texts = [], [], [], [], []
    for src, df in enumerate(frames):
        cols = data_columns(df, ["sheet_id"], None)
        types = [df.schema[c].dataType for c in cols]
        names += [f"{src}:{c}" for c in cols]
        places += range(len(cols))
        numbers += [schema_kind(t) in ("int", "float") for t in types]
        texts += [isinstance(t, (T.StringType, T.DateType)) for t in types]
        if exact:
            part = _value_groups(df, ["sheet_id"], cols, nulls)
        else:
            part = _counts(df, ["sheet_id"], cols, nulls, exact=False).drop("position")
        parts.append(part.withColumn("src", F.lit(src)))
    counts = reduce(DataFrame.unionByName, parts)
    if exact:
        counts = _fold_groups(counts, [F.col("sheet_id"), F.col("src"), F.col("column")])
    facts = [
        f"named_struct('position', {p}, 'number', {str(n).lower()}, 'text', {str(t).lower()})"
        for p, n, t in zip(places, numbers, texts)
    ]
    fact = _lookup(names, facts, F.concat_ws(":", "src", "column"))
    counts = counts.withColumn("__f", fact)
    total, valued = F.col("total_rows"), F.col("valued")
    kind = column_type(
        valued,
        F.when(F.col("__f.number"), valued).otherwise(0),
        F.when(F.col("__f.text"), F.col("ten_long")).otherwise(0),
    )
    return counts.select(
        F.col("sheet_id").cast("string").alias("sheet_id"), "column",
        F.col("__f.position").alias("position"), "total_rows", "non_null",
        ratio(total - F.col("non_null"), total).alias("null_rate"),
        "distinct_count",
        ratio(F.col("distinct_count"), total).alias("uniqueness"),
        kind.alias("data_type"),
    )


def profile_cells(cells: DataFrame, nulls: str = "blank") -> DataFrame:
    """Profiles of a corpus whose sheets have their own headers.

    Level one groups on the cell value (spread by value, so one huge sheet does
    not pile up), level two folds the value counts per column.
    """
    missing = F.col("raw").isNull() | (F.col("kind") == "null")
    if nulls == "blank":
        missing = missing | (F.col("raw") == "")
    by_value = cells.groupBy("sheet_id", "column", "col_no", F.col("raw")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~missing).alias("filled"),
        F.count_if(F.col("kind") != "null").alias("valued"),
        F.count_if(F.col("kind").isin("int", "float")).alias("numbers"),
        F.count_if((F.col("kind") == "text") & (F.length("raw") == 10)).alias("ten_long"),
    )
    folded = by_value.groupBy("sheet_id", "column", "col_no").agg(
        F.sum("rows").alias("total_rows"),
        F.sum("filled").alias("non_null"),
        F.count_if(F.col("filled") > 0).alias("distinct_count"),
        F.sum("valued").alias("valued"),
        F.sum("numbers").alias("numbers"),
        F.sum("ten_long").alias("ten_long"),
    )
    total = F.col("total_rows")
    return folded.select(
        "sheet_id", "column", F.col("col_no").alias("position"), "total_rows", "non_null",
        ratio(total - F.col("non_null"), total).alias("null_rate"),
        "distinct_count",
        ratio(F.col("distinct_count"), total).alias("uniqueness"),
        column_type(F.col("valued"), F.col("numbers"), F.col("ten_long")).alias("data_type"),
    )

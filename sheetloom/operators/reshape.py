"""Row caps, cells, header repair and column filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom import dictionary as fixed
from sheetloom.functions.exprs import (
    as_list,
    bound,
    contains_any,
    data_columns,
    inline_structs,
    is_float,
    is_missing,
    is_number,
    join_on,
    q,
    schema_kind,
    strip,
    text_kind,
)

from sheetloom.plans.lineage import materialize

BLANK_HEADER = "列"
By = str | Sequence[str] | None


def cap_rows(df: DataFrame, by: By, order: str | Sequence[str], n: int = 100) -> DataFrame:
    """First ``n`` rows of each group in the given order.

    The rank filter becomes a per-task group limit before the shuffle, so a
    huge group moves at most ``n`` rows per task.
    """
    keys = as_list(by)
    if not keys:
        return df.orderBy(*[q(o) for o in as_list(order)]).limit(n)
    window = W.partitionBy(*[q(k) for k in keys]).orderBy(*[q(o) for o in as_list(order)])
    return df.withColumn("__rank", F.row_number().over(window)).where(
        F.col("__rank") <= n
    ).drop("__rank")


def sheet_meta(df: DataFrame, by: str, n: int = 100) -> DataFrame:
    """Original rows, kept rows and truncation per sheet, plus a total row.

    The total row has a NULL sheet id: sums, and whether any sheet was cut.
    """
    per_sheet = df.groupBy(q(by).alias("sheet_id")).agg(
        F.count(F.lit(1)).alias("original_rows")
    ).withColumn("data_rows", F.least("original_rows", F.lit(n).cast("long")))
    return per_sheet.rollup("sheet_id").agg(
        F.sum("original_rows").alias("original_rows"),
        F.sum("data_rows").alias("data_rows"),
        F.bool_or(F.col("original_rows") > n).alias("truncated"),
    )


def cap_frame(df: DataFrame, order: str | Sequence[str], max_rows: int = 100,
              max_cols: int = 20) -> DataFrame:
    """Leading rows and leading columns; pruned columns never leave the scan."""
    return df.orderBy(*[q(o) for o in as_list(order)]).limit(max_rows).select(
        *[q(c) for c in df.columns[:max_cols]]
    )


def frame_shape(df: DataFrame, max_rows: int = 100, max_cols: int = 20) -> DataFrame:
    """Shape before and after ``cap_frame``."""
    return df.agg(F.count(F.lit(1)).alias("original_rows")).select(
        "original_rows",
        F.lit(len(df.columns)).alias("original_cols"),
        F.least("original_rows", F.lit(max_rows).cast("long")).alias("kept_rows"),
        F.lit(min(len(df.columns), max_cols)).alias("kept_cols"),
        ((F.col("original_rows") > max_rows) | F.lit(len(df.columns) > max_cols))
        .alias("truncated"),
    )


# -------------------------------------------------------------------- cells


def to_cells(df: DataFrame, row_id: str, by: str | None = None, sheet: str = "sheet",
             columns: Sequence[str] | None = None, infer: bool = False) -> DataFrame:
    """One row per cell: text value and kind.

    Kinds follow the schema; ``infer=True`` reads them from text columns too.
    """
    cols = data_columns(df, [*as_list(by), row_id], columns)
    rows = []
    for i, c in enumerate(cols):
        dtype = df.schema[c].dataType
        missing = is_missing(q(c), dtype, "strict")
        raw = F.when(~missing, q(c).cast("string"))
        if infer and isinstance(dtype, T.StringType):
            kind = text_kind(q(c))
        else:
            kind = F.when(missing, "null").otherwise(schema_kind(dtype))
        rows.append(
            F.struct(F.lit(i).alias("col_no"), F.lit(c).alias("column"),
                     raw.alias("raw"), kind.alias("kind"))
        )
    name = q(by).cast("string") if by else F.lit(sheet)
    return df.select(
        name.alias("sheet_id"), q(row_id).cast("long").alias("row_no"), inline_structs(rows)
    )


def from_cells(cells: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows again: typed by explicit ``columns``, else one map per row.

    In a map a blank header gets a name and a repeated one the first free number.
    """
    if columns is not None:
        return cells.groupBy("sheet_id", "row_no").pivot("column", list(columns)).agg(
            F.first("raw", ignorenulls=True)
        )
    entries = F.sort_array(F.collect_list(F.struct("col_no", "column", "raw")))
    rows = cells.groupBy("sheet_id", "row_no").agg(entries.alias("__e"))
    names = F.transform("__e", lambda e: F.coalesce(e.column, F.lit(BLANK_HEADER)))
    unique = bound(names, lambda n: F.when(F.size(F.array_distinct(n)) == F.size(n), n).otherwise(free_names(n)))
    return rows.select("sheet_id", "row_no", F.map_from_arrays(unique, F.transform("__e", lambda e: e.raw)).alias("row"))


def infer_cell_kind(cells: DataFrame) -> DataFrame:
    """Sets ``kind`` from the text of each cell."""
    return cells.withColumn("kind", text_kind(F.col("raw")))


def normalize_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN to NULL, numbers kept, everything else text."""
    chosen = set(data_columns(df, [], columns))
    out = []
    for c in df.columns:
        dtype = df.schema[c].dataType
        if c not in chosen:
            out.append(q(c))
        elif is_float(dtype):
            out.append(F.when(~F.isnan(q(c)), q(c)).alias(c))
        elif is_number(dtype):
            out.append(q(c))
        else:
            out.append(q(c).cast("string").alias(c))
    return df.select(*out)


# ------------------------------------------------------------------ headers


def is_unnamed(header: Column) -> Column:
    return header.isNull() | (strip(header) == "") | F.lower(header).startswith("unnamed")


def unnamed_ratio(headers: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Share of blank or ``unnamed`` headers per sheet, and whether to repair."""
    share = F.avg(F.when(is_unnamed(F.col("header")), 1.0).otherwise(0.0))
    return headers.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("headers"), share.alias("unnamed_ratio")
    ).withColumn("repair", F.col("unnamed_ratio") >= threshold)


def detect_header_row(cells: DataFrame, scan: int = 10) -> DataFrame:
    """Among the first rows, the one with most non-blank texts; earliest on ties."""
    texts = F.count_if((F.col("kind") == "text") & (strip(F.col("raw")) != ""))
    scored = cells.where(F.col("row_no") < scan).groupBy("sheet_id", "row_no").agg(
        texts.alias("score")
    )
    best = scored.groupBy("sheet_id").agg(
        F.max(F.struct(F.col("score"), (-F.col("row_no")).alias("neg"))).alias("__b")
    )
    return best.where(F.col("__b.score") > 0).select(
        "sheet_id", (-F.col("__b.neg")).alias("header_row"), F.col("__b.score").alias("score")
    )


def dedupe_headers(headers: DataFrame, cut: bool = True) -> DataFrame:
    """Trim, name blanks, and number repeats ``_1``, ``_2`` in column order.

    A numbered name may meet an existing header (``a, a, a_1``); a further pass
    numbers the later column again, and what still meets another name takes the
    first free number.  The names are written once (``cut``).
    """
    base = F.when(
        F.col("header").isNull() | (strip(F.col("header")) == ""), F.lit(BLANK_HEADER)
    ).otherwise(strip(F.col("header")))
    named = headers.withColumn("__base", base)
    return _settle(_number_repeats(named, "__base", "column").drop("__base"), cut)


def _number_repeats(df: DataFrame, source: str, target: str) -> DataFrame:
    window = W.partitionBy("sheet_id", source).orderBy("col_no")
    k = F.row_number().over(window) - 1
    return df.withColumn(
        target, F.when(k > 0, F.concat_ws("_", q(source), k.cast("string"))).otherwise(q(source))
    )


def free_names(names: Column) -> Column:
    """Names told apart: one that was there before takes the first free number."""

    def free(taken: Column, name: Column) -> Column:
        numbers = F.sequence(F.lit(1), F.size(taken) + 1)
        numbered = F.transform(numbers, lambda k: F.concat_ws("_", name, k.cast("string")))
        first = F.get(F.filter(numbered, lambda n: ~F.array_contains(taken, n)), 0)
        return F.when(F.array_contains(taken, name), first).otherwise(name)

    return F.aggregate(names, F.array().cast("array<string>"), lambda taken, x: F.concat(taken, F.array(free(taken, x))))


def _settle(df: DataFrame, cut: bool) -> DataFrame:
    """Names unique per sheet.

    A name that comes twice can only take the place of its own numbered forms (``x_1``, ``x_1_2``).  So only the
    families of repeated names are put together, each in one row; all other names stay as they are.
    """
    again = _number_repeats(df, "column", "column")
    if cut:
        again = materialize(again)
    names = again.groupBy("sheet_id", "column").agg(F.count(F.lit(1)).alias("__n"))
    repeated = names.where("__n > 1").select("sheet_id", F.col("column").alias("__root"))
    if cut:
        repeated = materialize(repeated)
        if repeated.isEmpty():
            return again
    others = [c for c in again.columns if c not in ("sheet_id", "col_no", "column")]
    # the first of the repeated names that a name is a numbered form of
    inner = repeated.select("sheet_id", "__root", F.explode(_forms(F.col("__root"))).alias("__f")).where("__f <> __root")
    outer = repeated.withColumnRenamed("__root", "__f")
    roots = join_on(repeated, join_on(inner, outer, ["sheet_id", "__f"], "left_semi"), ["sheet_id", "__root"], "left_anti")
    forms = names.select("sheet_id", "column", F.explode(_forms(F.col("column"))).alias("__root"))
    families = join_on(forms, roots, ["sheet_id", "__root"], "left_semi")
    named = join_on(again, materialize(families) if cut else families, ["sheet_id", "column"], "left")

    packed = named.where("__root IS NOT NULL").groupBy("sheet_id", "__root").agg(F.array_sort(F.collect_list(
        F.struct("col_no", "column", *[q(c) for c in others]))).alias("__h"))
    told = free_names(F.transform("__h", lambda x: x["column"]))
    rows = packed.withColumn("__n", told).select("sheet_id", F.inline(F.transform("__h", lambda x, i: F.struct(
        x["col_no"].alias("col_no"), F.get("__n", i).alias("column"), *[x[c].alias(c) for c in others]))))
    columns = [q(c) for c in again.columns]
    return named.where("__root IS NULL").select(*columns).unionByName(rows.select(*columns))


def _forms(name: Column) -> Column:
    """A name and what it is a numbered form of: ``x_1_2``, ``x_1``, ``x``."""
    ends = F.regexp_extract_all(F.regexp_extract(name, r"((?:_[0-9]+)*)\z", 1), F.lit("_[0-9]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(ends)), lambda n: F.substring(
        name, F.lit(1), F.length(name) - F.length(F.array_join(F.slice(ends, F.size(ends) - n + 1, n), ""))))


def promote_header(cells: DataFrame, header_rows: DataFrame, cut: bool = True, top: DataFrame | None = None,
                   headers: DataFrame | None = None) -> DataFrame:
    """Header cells become column names, rows through it go, rest is renumbered.

    Sheets without a detected header row keep their cells; with ``headers``
    (sheet_id, col_no, header) their names are cleaned and told apart too.  ``top``
    holds the cells of the first rows, so that ``cells`` need not be read for them.
    The names (one row per sheet) are written once (``cut``): while they are small,
    the cells stay where they are instead of being shuffled.
    """
    found = header_rows.select("sheet_id", F.col("header_row").alias("row_no"))
    if cut:
        found = materialize(found)
    header_cells = join_on(cells if top is None else top, found, ["sheet_id", "row_no"], "left_semi").select(
        "sheet_id", "row_no", "col_no",
        F.when(~is_unnamed(F.col("raw")), F.col("raw")).alias("header"),
    )
    if headers is not None:
        rest = join_on(headers, found, ["sheet_id"], "left_anti")
        header_cells = header_cells.unionByName(rest.select(
            "sheet_id", F.lit(None).cast("long").alias("row_no"), "col_no", "header"))
    # one small row per sheet: header row and its names by column number
    repair = dedupe_headers(header_cells, cut).groupBy("sheet_id").agg(
        F.max("row_no").alias("__at"),
        F.map_from_entries(F.collect_list(F.struct("col_no", "column"))).alias("__names"),
    )
    joined = join_on(cells, materialize(repair) if cut else repair, ["sheet_id"], "left")
    body = joined.where(F.col("__at").isNull() | (F.col("row_no") > F.col("__at")))
    return body.select(
        "sheet_id",
        F.coalesce(F.col("row_no") - F.col("__at") - 1, F.col("row_no")).alias("row_no"),
        "col_no",
        F.coalesce(F.element_at("__names", F.col("col_no")), F.col("column")).alias("column"),
        "raw", "kind",
    )


def column_tops(cells: DataFrame, scan: int = 10) -> DataFrame:
    """(sheet_id, col_no, column, top): each column with its cells of the first rows, from one pass."""
    cell = F.struct("row_no", "raw", "kind")
    return cells.groupBy("sheet_id", "col_no").agg(
        F.max("column").alias("column"), F.collect_list(F.when(F.col("row_no") < scan, cell)).alias("top"))


# ------------------------------------------------------------- column filters


def drop_sparse(profiles: DataFrame, threshold: float = 0.9,
                protected: Sequence[str] = fixed.PROTECTED_SHIPPER_WORDS) -> DataFrame:
    """Drops columns emptier than ``threshold`` unless a protected word occurs."""
    return profiles.where(
        (F.col("null_rate") <= threshold) | contains_any(F.col("column"), list(protected))
    )


def drop_constant(df: DataFrame, by: By = None,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """(group, column) pairs that are worth keeping: not all 0 and not all 1."""
    keys = as_list(by)
    cols = data_columns(df, keys, columns)
    aggs = []
    for i, c in enumerate(cols):
        value = q(c).try_cast("double") if isinstance(df.schema[c].dataType, T.StringType) \
            else q(c).cast("double") if is_number(df.schema[c].dataType) else F.lit(None)
        aggs += [
            F.min(value.cast("double")).alias(f"__l{i}"),
            F.max(value.cast("double")).alias(f"__h{i}"),
            (F.count(q(c)) - F.count(value)).alias(f"__t{i}"),
        ]
    wide = df.groupBy(*[q(k) for k in keys]).agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"),
            F.coalesce(
                (F.col(f"__t{i}") == 0) & (F.col(f"__l{i}") == F.col(f"__h{i}"))
                & F.col(f"__l{i}").isin(0.0, 1.0),
                F.lit(False),
            ).alias("constant"),
        )
        for i, c in enumerate(cols)
    ]
    long = wide.select(*[q(k) for k in keys], inline_structs(rows))
    return long.where(~F.col("constant")).drop("constant")


def drop_all_null(profiles: DataFrame) -> DataFrame:
    """Columns with at least one value."""
    return profiles.where(F.col("non_null") > 0)

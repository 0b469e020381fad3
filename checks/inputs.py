"""Sheets derived from the given tables, in Spark and as SQL text.

The tables hold no nulls, so the same value rule puts some in on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.operators.classify import classify
from sheetloom.operators.profiling import profile_corpus
from sheetloom.operators.reshape import to_cells


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dbl(x: float) -> str:
    """A SQL literal DuckDB reads as DOUBLE."""
    return f"{x!r}e0"


def rnd(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    scale = float(10**digits)
    fixed = {c: (F.floor(F.col(c) * scale + 0.5).cast("double") / scale) for c in cols}
    return df.withColumns(fixed)


def srnd(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def in_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(name: str, words) -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


# ------------------------------------------------------------------ line sheets

LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]
LINE_NUM = [c for c in LINE_COLS if c not in ("l_linestatus", "l_shipdate")]


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as one sheet per return flag."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("sheet_id"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_linestatus", F.lit("F")).alias("l_linestatus"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
    )


LINES = """lines AS (
  SELECT l_returnflag AS sheet_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
         l_extendedprice, nullif(l_discount, 0e0) AS l_discount, nullif(l_tax, 0e0) AS l_tax,
         nullif(l_linestatus, 'F') AS l_linestatus,
         strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
  FROM lineitem)"""


# ----------------------------------------------------------------- order sheets

ORDER_COLS = ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_ref"]
ORDER_KIND = {"o_custkey": "int", "o_totalprice": "float"}


def order_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Orders as one sheet per status, with a column of mixed texts."""
    pri = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("sheet_id"), "o_orderkey", "o_custkey", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.nullif(pri, F.lit("5-LOW")).alias("o_orderpriority"),
        F.when(pri == "1-URGENT", F.col("o_custkey").cast("string"))
        .when(pri == "2-HIGH", "12.5").when(pri == "3-MEDIUM", pri)
        .when(pri == "5-LOW", "").alias("o_ref"),
    )


ORDERS = """ords AS (
  SELECT o_orderstatus AS sheet_id, o_orderkey, o_custkey, o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
         nullif(o_orderpriority, '5-LOW') AS o_orderpriority,
         CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_custkey AS VARCHAR) WHEN '2-HIGH' THEN '12.5'
              WHEN '3-MEDIUM' THEN o_orderpriority WHEN '5-LOW' THEN '' END AS o_ref
  FROM orders)"""


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    return to_cells(order_sheets(spark, d), "o_orderkey", "sheet_id", infer=True)


def kind_sql(raw: str) -> str:
    return (
        f"CASE WHEN {raw} IS NULL THEN 'null' "
        f"WHEN regexp_matches({raw}, '^[+-]?[0-9]+$') THEN 'int' "
        f"WHEN regexp_matches({raw}, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') "
        f"THEN 'float' WHEN lower({raw}) IN ('true', 'false') THEN 'bool' ELSE 'text' END"
    )


def _cell_sql(i: int, c: str) -> str:
    kind = ORDER_KIND.get(c)
    kind = f"CASE WHEN {c} IS NULL THEN 'null' ELSE '{kind}' END" if kind else kind_sql(c)
    return (f"SELECT sheet_id, o_orderkey AS row_no, {i} AS col_no, '{c}' AS \"column\", "
            f"CAST({c} AS VARCHAR) AS raw, {kind} AS kind FROM ords")


CELLS = ORDERS + ",\ncells AS (\n" + "\nUNION ALL ".join(
    _cell_sql(i, c) for i, c in enumerate(ORDER_COLS)) + ")"


# -------------------------------------------------------------------- profiles

#: table, group column, [(column, kind)]; dates become ten-character texts
CORPUS = [
    ("orders", "o_orderstatus", [("o_orderkey", "num"), ("o_custkey", "num"), ("o_totalprice", "num"),
                                 ("o_orderdate", "day"), ("o_orderpriority", "text")]),
    ("lineitem", "l_returnflag", [("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"),
                                  ("l_linenumber", "num"), ("l_quantity", "num"),
                                  ("l_extendedprice", "num"), ("l_discount", "nul"),
                                  ("l_tax", "nul"), ("l_linestatus", "text"),
                                  ("l_shipdate", "day")]),
    ("customer", "c_mktsegment", [("c_custkey", "num"), ("c_name", "text"), ("c_nationkey", "num"),
                                  ("c_acctbal", "num")]),
    ("part", "p_type", [("p_partkey", "num"), ("p_name", "text"), ("p_brand", "text"),
                        ("p_size", "num"), ("p_retailprice", "num")]),
    ("supplier", "s_nationkey", [("s_suppkey", "num"), ("s_name", "text"), ("s_acctbal", "num")]),
]


def corpus_frames(spark: SparkSession, d: str) -> list[DataFrame]:
    frames = []
    for name, group, cols in CORPUS:
        def pick(c, kind):
            if kind == "day":
                return F.date_format(c, "yyyy-MM-dd").alias(c)
            if kind == "nul":
                return F.nullif(F.col(c), F.lit(0.0)).alias(c)
            return F.col(c)
        frames.append(table(spark, d, name).select(
            F.concat(F.lit(name + "/"), F.col(group).cast("string")).alias("sheet_id"),
            *[pick(c, k) for c, k in cols]))
    return frames


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of every sheet of the corpus."""
    return profile_corpus(corpus_frames(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return classify(profiles(spark, d))


def _profile_sql(name: str, group: str, i: int, c: str, kind: str) -> str:
    value = {"day": f"strftime({c}, '%Y-%m-%d')", "nul": f"nullif({c}, 0e0)"}.get(kind, c)
    there = f"({value}) IS NOT NULL" + (f" AND ({value}) <> ''" if kind in ("text", "day") else "")
    n = f"count(*) FILTER (WHERE {there})"
    d = f"count(DISTINCT ({value})) FILTER (WHERE {there})"
    if kind in ("num", "nul"):
        dtype = f"CASE WHEN {n} = 0 THEN 'text' ELSE 'numeric' END"
    else:
        dtype = (f"CASE WHEN count({value}) = 0 THEN 'text' WHEN count(*) FILTER (WHERE length({value}) = 10) "
                 f"= count({value}) THEN 'date' ELSE 'text' END")
    return (f"SELECT '{name}/' || CAST({group} AS VARCHAR) AS sheet_id, '{c}' AS \"column\", {i} AS position, "
            f"count(*) AS total_rows, {n} AS non_null, "
            f"CAST(count(*) - {n} AS DOUBLE) / count(*) AS null_rate, {d} AS distinct_count, "
            f"CAST({d} AS DOUBLE) / count(*) AS uniqueness, {dtype} AS data_type "
            f"FROM {name} GROUP BY {group}")


PROFILES = "profiles AS MATERIALIZED (\n" + "\nUNION ALL ".join(
    _profile_sql(name, group, i, c, k)
    for name, group, cols in CORPUS for i, (c, k) in enumerate(cols)) + ")"

DATE_WORDS = ["日期", "时间", "date", "time"]
ID_WORDS = ["编号", "编码", "code", "id", "号"]
QTY_WORDS = ["数量", "件数", "体积", "重量", "count", "volume", "weight"]
NAME_WORDS = ["名称", "name", "地址", "address", "公司", "company"]
PRICE_WORDS = ["价格", "金额", "price", "amount", "cost"]

CATEGORY = (
    f"CASE WHEN {any_of('lower(\"column\")', DATE_WORDS)} OR data_type = 'date' THEN 'date' "
    f"WHEN {any_of('lower(\"column\")', ID_WORDS)} AND uniqueness > 0.8e0 THEN 'identifier' "
    f"WHEN {any_of('lower(\"column\")', QTY_WORDS)} AND data_type = 'numeric' THEN 'quantity' "
    f"WHEN {any_of('lower(\"column\")', NAME_WORDS)} THEN 'name' ELSE 'unknown' END"
)

CLASSIFIED = PROFILES + f",\nclassified AS MATERIALIZED (SELECT *, {CATEGORY} AS category FROM profiles)"

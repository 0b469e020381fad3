"""Relationship evidence between columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import match
from checks.inputs import LINES, PROFILES, any_of, lines, profiles, rnd, srnd, table
from sheetloom.dictionary import ENGLISH
from sheetloom.operators import evidence as ev
from sheetloom.operators import matching as mt
from sheetloom.operators import profiling as pr

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("cardinality_band", f"""WITH {PROFILES} SELECT sheet_id, "column", distinct_count FROM profiles
  WHERE distinct_count BETWEEN 1 AND 10""")
def _(spark, d):
    return ev.cardinality_band(profiles(spark, d), 1, 10).select("sheet_id", "column", "distinct_count")


@query("cardinality_contrast", f"""WITH {PROFILES}, c AS (SELECT sheet_id, max(distinct_count) FILTER (WHERE "column" = 'l_partkey')
  AS many_count, max(distinct_count) FILTER (WHERE "column" = 'l_suppkey') AS few_count FROM profiles GROUP BY sheet_id)
SELECT *, CAST(many_count AS DOUBLE) / few_count AS ratio, many_count >= few_count * 2 AS contrasts FROM c
  WHERE many_count IS NOT NULL AND few_count IS NOT NULL""")
def _(spark, d):
    return ev.cardinality_contrast(profiles(spark, d), "l_partkey", "l_suppkey")


@query("key_grain", """SELECT *, CASE WHEN key_count = row_count THEN 'key' WHEN pair_count = row_count THEN 'key+detail'
  ELSE 'none' END AS grain FROM (SELECT l_returnflag, count(*) AS row_count, count(DISTINCT l_orderkey) AS key_count,
  count(DISTINCT (l_orderkey, l_partkey)) AS pair_count FROM lineitem GROUP BY l_returnflag) x""")
def _(spark, d):
    return ev.key_grain(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_returnflag").select(
        "l_returnflag", "row_count", "key_count", "pair_count", "grain")


@query("key_grain_whole", """SELECT count(*) AS row_count, count(DISTINCT o_orderkey) AS key_count,
  count(DISTINCT (o_orderkey, o_custkey)) AS pair_count, 'key' AS grain FROM orders""")
def _(spark, d):
    return ev.key_grain(table(spark, d, "orders"), "o_orderkey", "o_custkey")


@query("date_order", """SELECT l_returnflag, count(*) AS pairs, count(*) FILTER (WHERE g >= 0) AS ordered,
  count(*) FILTER (WHERE g BETWEEN 0 AND 3) AS in_gap FROM (SELECT l_returnflag,
    date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x
GROUP BY l_returnflag""")
def _(spark, d):
    both = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return ev.date_order(both, "o_orderdate", "l_shipdate", by="l_returnflag")


_BARS = {"ship_date": ["price"], "quantity": ["tax", "discount"], "order_key": ["part"]}
_BAD = " OR ".join(f"(std_field = '{s}' AND {any_of('lower(\"column\")', w)})" for s, w in _BARS.items())


@query("exclude_by_token", f"""WITH {match.SIMS} SELECT sheet_id, "column", std_field FROM sims WHERE NOT ({_BAD})""")
def _(spark, d):
    s = mt.similarity_scores(profiles(spark, d), ENGLISH)
    return ev.exclude_by_token(s, _BARS).select("sheet_id", "column", "std_field")


_CODED = any_of('lower("column")', ["编号", "编码", "代码", "code", "id", "key"])


@query("prefer_code", f"""WITH {match.SIMS} SELECT sheet_id, "column", std_field, {_CODED} AS is_code,
  CAST(row_number() OVER (PARTITION BY sheet_id, std_field ORDER BY {_CODED} DESC, score DESC, col_pos) AS INT) AS rank
  FROM sims""")
def _(spark, d):
    s = mt.similarity_scores(profiles(spark, d), ENGLISH)
    return ev.prefer_code(s).select("sheet_id", "column", "std_field", "is_code", "rank")


def _fan(a: str, b: str, src: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    gb = f" GROUP BY {by}" if by else ""
    on = f" USING ({by})" if by else " ON TRUE"
    return (f"(SELECT {g}max(n) AS max_b_per_a FROM (SELECT {g}{a}, count(DISTINCT {b}) AS n FROM {src} "
            f"GROUP BY {g}{a}) x{gb}) p JOIN (SELECT {g}max(n) AS max_a_per_b FROM (SELECT {g}{b}, "
            f"count(DISTINCT {a}) AS n FROM {src} GROUP BY {g}{b}) y{gb}) r{on}")


@query("bijection", f"""SELECT c_mktsegment, max_b_per_a, max_a_per_b, max_b_per_a = 1 AND max_a_per_b = 1 AS one_to_one
  FROM {_fan('c_custkey', 'c_name', 'customer', 'c_mktsegment')}""")
def _(spark, d):
    return ev.bijection(table(spark, d, "customer"), "c_custkey", "c_name", "c_mktsegment")


@query("bijection_whole", f"""SELECT max_b_per_a, max_a_per_b, max_b_per_a = 1 AND max_a_per_b = 1 AS one_to_one
  FROM {_fan('p_name', 'p_brand', 'part')}""")
def _(spark, d):
    return ev.bijection(table(spark, d, "part"), "p_name", "p_brand")


_KIND = ("CASE WHEN max_a_per_b > 1 AND max_b_per_a > 1 THEN 'N:M' WHEN max_a_per_b > 1 THEN 'N:1' "
         "WHEN max_b_per_a > 1 THEN '1:N' ELSE '1:1' END AS relation")


@query("relation_kind", "\nUNION ALL ".join(
    f"SELECT '{n}' AS pair, max_b_per_a, max_a_per_b, {_KIND} FROM {_fan(a, b, t)}" for n, a, b, t in (
        ("order-customer", "o_orderkey", "o_custkey", "orders"),
        ("order-part", "l_orderkey", "l_partkey", "lineitem"),
        ("customer-name", "c_custkey", "c_name", "customer"),
        ("region-nation", "n_regionkey", "n_nationkey", "nation"))))
def _(spark, d):
    pairs = (("order-customer", "o_orderkey", "o_custkey", "orders"),
             ("order-part", "l_orderkey", "l_partkey", "lineitem"),
             ("customer-name", "c_custkey", "c_name", "customer"),
             ("region-nation", "n_regionkey", "n_nationkey", "nation"))
    out = None
    for n, a, b, t in pairs:
        one = ev.relation_kind(table(spark, d, t), a, b).withColumn("pair", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


_DEPS = ["l_linestatus", "l_suppkey", "l_shipdate", "l_quantity"]


@query("functional_dependency", "\nUNION ALL ".join(
    f"SELECT l_returnflag, count(*) AS groups, '{c}' AS dependent, count(*) FILTER (WHERE n > 1) AS violating_groups, "
    f"count(*) FILTER (WHERE n > 1) = 0 AS holds FROM (SELECT l_returnflag, l_orderkey, count(DISTINCT {c}) AS n "
    f"FROM lineitem GROUP BY l_returnflag, l_orderkey) x GROUP BY l_returnflag" for c in _DEPS))
def _(spark, d):
    return ev.functional_dependency(table(spark, d, "lineitem"), "l_orderkey", _DEPS, "l_returnflag")


@query("dependency_violations", """SELECT l_orderkey, min(l_suppkey) AS low, max(l_suppkey) AS high, count(*) AS rows
  FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1""")
def _(spark, d):
    return ev.dependency_violations(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("sequence_consistency", f"""SELECT l_orderkey, max_b_per_a, max_a_per_b, max_b_per_a = 1 AND max_a_per_b = 1
  AS consistent FROM {_fan('l_suppkey', 'l_linenumber', 'lineitem', 'l_orderkey')}""")
def _(spark, d):
    return ev.sequence_consistency(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")


@query("co_zero", """SELECT l_linestatus, count(*) AS row_count, count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0)
  AS both_zero, CAST(count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0) AS DOUBLE) / count(*) AS share
  FROM lineitem GROUP BY l_linestatus""")
def _(spark, d):
    return ev.co_zero(table(spark, d, "lineitem"), "l_discount", "l_tax", "l_linestatus")


_STAT = [("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"),
         ("l_discount", "nullif(l_discount, 0e0)"), ("l_tax", "nullif(l_tax, 0e0)")]


@query("rank_quantity_candidates", "WITH s AS (" + "\nUNION ALL ".join(
    f"SELECT l_returnflag AS sheet_id, '{c}' AS \"column\", {i} AS position, "
    f"CAST(count(*) - count({e}) AS DOUBLE) / count(*) AS null_rate, abs(stddev_samp({e}) / avg({e})) AS cv "
    f"FROM lineitem GROUP BY l_returnflag" for i, (c, e) in enumerate(_STAT)) + f""")
SELECT sheet_id, "column", null_rate, {srnd('cv', 4)} AS variation, CAST(row_number() OVER (PARTITION BY sheet_id
  ORDER BY null_rate, cv DESC, position) AS INT) AS rank FROM s""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("sheet_id"), "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    m = pr.quality_metrics(li, "sheet_id", exact=False)
    stats = m.withColumn("null_rate", F.col("null_count") / F.col("total_rows"))
    return rnd(ev.rank_quantity_candidates(stats), 4, "variation").select(
        "sheet_id", "column", "null_rate", "variation", "rank")


#: mapped columns whose names carry a unit, from part names and sizes
@query("unit_reminders", """WITH m AS (SELECT p_type AS sheet_id, p_partkey, CASE WHEN p_size < 25 THEN 'volume' ELSE 'weight' END
  AS std_field, p_name || CASE WHEN p_size < 10 THEN ' (CBM)' WHEN p_size < 20 THEN '[l]' WHEN p_size < 30 THEN ''
  WHEN p_size < 40 THEN '_kg' ELSE ' (ton)' END AS "column", p_size FROM part),
u AS (SELECT *, CASE WHEN p_size < 10 THEN 'cbm' WHEN p_size < 20 THEN 'l' WHEN p_size >= 40 THEN 'ton'
  WHEN p_size >= 30 THEN 'kg' END AS unit FROM m)
SELECT sheet_id, std_field, "column", unit, CASE WHEN unit IS NULL THEN 'unknown' WHEN unit IN ('cbm', 'kg') THEN 'ok'
  ELSE 'convert' END AS reminder FROM u""")
def _(spark, d):
    size = F.col("p_size")
    suffix = (F.when(size < 10, " (CBM)").when(size < 20, "[l]").when(size < 30, "")
              .when(size < 40, "_kg").otherwise(" (ton)"))
    m = table(spark, d, "part").select(
        F.col("p_type").alias("sheet_id"),
        F.when(size < 25, "volume").otherwise("weight").alias("std_field"),
        F.concat("p_name", suffix).alias("column"))
    return ev.unit_reminders(m, "volume", "weight")


@query("pattern_share", """SELECT lang, count(url) AS filled, count(*) FILTER (WHERE regexp_matches(url, '/[0-9]+\\?page='))
  AS matching, CAST(count(*) FILTER (WHERE regexp_matches(url, '/[0-9]+\\?page=')) AS DOUBLE) / count(url) AS share
  FROM (SELECT url, regexp_extract(url, 'com/([a-z]*)', 1) AS lang FROM pages) x GROUP BY lang""")
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("lang", F.regexp_extract("url", "com/([a-z]*)", 1))
    return ev.pattern_share(pages, "url", r"/[0-9]+\?page=", "lang")


@query("key_candidates", f"""WITH {PROFILES} SELECT sheet_id, "column", CAST(row_number() OVER (PARTITION BY sheet_id
  ORDER BY uniqueness DESC, position) AS INT) AS rank FROM profiles WHERE null_rate = 0""")
def _(spark, d):
    return ev.key_candidates(profiles(spark, d)).select("sheet_id", "column", "rank")


_PAIRS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


def _pair_sql(a: str, b: str) -> str:
    def side(of: str, other: str, name: str) -> str:
        return (f"(SELECT sheet_id, max(n) AS {name} FROM (SELECT sheet_id, {of}, count(DISTINCT {other}) AS n FROM lines "
                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY sheet_id, {of}) z GROUP BY sheet_id)")
    return (f"SELECT x.sheet_id, '{a}' AS a, '{b}' AS b, max_b_per_a, max_a_per_b FROM {side(a, b, 'max_b_per_a')} x "
            f"JOIN {side(b, a, 'max_a_per_b')} y ON y.sheet_id = x.sheet_id")


@query("relation_matrix", f"WITH {LINES}, p AS (" + " UNION ALL ".join(
    _pair_sql(a, b) for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1:]) + """)
SELECT *, CASE WHEN max_a_per_b > 1 AND max_b_per_a > 1 THEN 'N:M' WHEN max_a_per_b > 1 THEN 'N:1' WHEN max_b_per_a > 1 THEN '1:N'
  ELSE '1:1' END AS relation FROM p""")
def _(spark, d):
    return ev.relation_matrix(lines(spark, d), _PAIRS, "sheet_id")

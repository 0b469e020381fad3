"""Structure, content and declared rules; scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import match
from checks.inputs import (
    CELLS,
    LINES,
    ORDERS,
    lines,
    order_cells,
    order_sheets,
    rnd,
    srnd,
    table,
)
from checks.profile import METRICS_SQL, ORACLES as PROFILE_SQL
from sheetloom.dictionary import ENGLISH
from sheetloom.operators import profiling as pr
from sheetloom.operators import validation as va
from sheetloom.plans.quality import nested_report, quality_report

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ------------------------------------------------------------------ envelopes

#: one JSON envelope per event, broken in a different way per event type
def envelopes(spark, d):
    n = F.col("user_id").cast("string")
    t = F.col("event_type")
    payload = (
        F.when(t == "view", F.concat(F.lit('{"filename":"f","total_rows":'), n,
                                     F.lit(',"columns":["k"],"data":['), F.col("props"), F.lit("]}")))
        .when(t == "click", F.concat(F.lit('{"filename":"f","total_rows":-'), n,
                                     F.lit(',"columns":{"k":1},"data":[]}')))
        .when(t == "error", F.concat(F.lit('{"total_rows":'), n, F.lit(',"data":3}')))
        .when(t == "signup", F.concat(F.lit('{"filename":"f","total_rows":"'), n,
                                      F.lit('","columns":[],"data":{}}')))
        .otherwise(F.concat(F.lit("not json "), n))
    )
    return table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("sheet_id"), payload.alias("payload"),
        F.col("user_id").alias("total_rows"), t.alias("event_type"))


_E = "SELECT CAST(event_id AS VARCHAR) AS sheet_id, 'structure' AS step, 'error' AS severity, "
ENVELOPE = "\nUNION ALL ".join(
    [f"{_E} '{k}' AS subject, 'missing_key' AS code, 'absent' AS detail FROM events WHERE event_type = 'purchase'"
     for k in ("filename", "total_rows", "columns", "data")]
    + [f"{_E} '{k}', 'missing_key', 'absent' FROM events WHERE event_type = 'error'"
       for k in ("filename", "columns")]
    + [f"{_E} 'total_rows', 'bad_total_rows', 'not a whole number' FROM events WHERE event_type = 'signup' "
       "OR event_type = 'click' AND user_id > 0",
       f"{_E} 'columns', 'not_a_list', 'not a list' FROM events WHERE event_type = 'click'",
       f"{_E} 'data', 'not_a_list', 'not a list' FROM events WHERE event_type = 'signup'"])


@query("check_envelope", ENVELOPE)
def _(spark, d):
    return va.check_envelope(envelopes(spark, d), "payload")


#: JSON rows: some lack a key, some have more, some are no object
def json_rows(spark, d):
    k = F.get_json_object("props", "$.k")
    t = F.col("event_type")
    row = (
        F.when(t == "view", F.col("props"))
        .when(t == "click", F.concat(F.lit('{"k": '), k, F.lit(', "v": 1, "sheet": "s"}')))
        .when(t == "error", F.concat(F.lit('{"k": '), k, F.lit(', "z": 1, "a": 2}')))
        .when(t == "signup", F.concat(F.lit("["), k, F.lit("]")))
        .otherwise(F.lit("broken"))
    )
    return table(spark, d, "events").select(
        F.col("user_id").alias("sheet_id"), "event_id", row.alias("payload"))


_C = ("SELECT CAST(user_id AS VARCHAR) AS sheet_id, 'structure' AS step, '{0}' AS severity, "
      "CAST(event_id AS VARCHAR) AS subject, '{1}' AS code, '{2}' AS detail FROM events WHERE event_type IN ({3})")
CONFORM = "\nUNION ALL ".join([
    _C.format("warning", "missing_columns", "v", "'view', 'error'"),
    _C.format("warning", "extra_columns", "a, z", "'error'"),
    _C.format("error", "row_not_object", "not an object", "'signup', 'purchase'"),
])


@query("row_conformance", CONFORM)
def _(spark, d):
    return va.row_conformance(json_rows(spark, d), "payload", ["k", "v"], "event_id")


@query("structure_score", f"""WITH f AS ({ENVELOPE}), c AS (SELECT sheet_id, count(*) AS e,
  count(*) FILTER (WHERE code = 'missing_key') AS m FROM f GROUP BY sheet_id),
x AS (SELECT CAST(event_id AS VARCHAR) AS sheet_id, user_id AS total_rows, coalesce(e, 0) AS errors,
  CAST(0 AS BIGINT) AS warnings, coalesce(m, 0) AS m FROM events LEFT JOIN c ON c.sheet_id = CAST(event_id AS VARCHAR))
SELECT sheet_id, total_rows, errors, warnings, CASE WHEN m > 0 OR total_rows = 0 THEN 0e0
  WHEN total_rows < 10 THEN greatest(0e0, (100e0 - errors * 20) * 0.8e0) ELSE greatest(0e0, 100e0 - errors * 20) END
  AS data_quality_score FROM x""")
def _(spark, d):
    env = envelopes(spark, d)
    return va.structure_score(va.check_envelope(env, "payload"), env)


# -------------------------------------------------------------------- content

_PCTTXT = "printf('%.2f', {0}) || '%'"
FACTS = CELLS + """,
nums AS (SELECT *, CASE WHEN kind IN ('int', 'float') THEN CAST(raw AS DOUBLE) END AS v FROM cells),
facts AS MATERIALIZED (SELECT sheet_id, "column", count(*) AS total_rows,
  CAST(count(*) FILTER (WHERE kind = 'null' OR raw = '') AS DOUBLE) / count(*) AS null_rate,
  string_agg(DISTINCT kind, ', ' ORDER BY kind) FILTER (WHERE kind <> 'null') AS kinds,
  count(DISTINCT kind) FILTER (WHERE kind <> 'null') AS n_kinds, count(v) AS numbers,
  coalesce(max(abs(v - m)) > 3e0 * any_value(s), FALSE) AS has_outliers
  FROM (SELECT *, avg(v) OVER (PARTITION BY sheet_id, "column") AS m,
    stddev_pop(v) OVER (PARTITION BY sheet_id, "column") AS s FROM nums) z GROUP BY sheet_id, "column")"""
_W = "SELECT sheet_id, 'content' AS step, 'warning' AS severity, \"column\" AS subject, "
CONTENT = f"""{_W} 'high_null_rate' AS code, {_PCTTXT.format(srnd('null_rate * 100', 2))} AS detail FROM facts WHERE null_rate > 0.5e0
UNION ALL {_W} 'mixed_types', kinds FROM facts WHERE n_kinds > 1
UNION ALL {_W} 'outliers', 'beyond 3 sigma' FROM facts WHERE has_outliers"""


@query("content_facts", f"""WITH {FACTS} SELECT sheet_id, "column", total_rows, null_rate, kinds, numbers, has_outliers FROM facts""")
def _(spark, d):
    return va.content_facts(order_cells(spark, d)).withColumn("kinds", F.nullif(
        F.array_join("kinds", ", "), F.lit("")))


@query("content_check", f"WITH {FACTS} {CONTENT}")
def _(spark, d):
    return va.content_check(order_cells(spark, d))


@query("high_null_warnings", f"""WITH {LINES}, p AS ({PROFILE_SQL['null_profile'][len(f'WITH {LINES}') + 1:]})
SELECT sheet_id, 'content' AS step, 'warning' AS severity, "column" AS subject, 'high_null_rate' AS code,
  {_PCTTXT.format(srnd('null_rate * 100', 2))} AS detail FROM p WHERE null_rate > 0.1e0""")
def _(spark, d):
    return va.high_null_warnings(pr.null_profile(lines(spark, d), "sheet_id"), 0.1)


@query("content_score", f"""WITH {FACTS}, f AS ({CONTENT}), w AS (SELECT sheet_id, count(*) AS n FROM f GROUP BY sheet_id),
a AS (SELECT sheet_id, avg(null_rate) AS r FROM facts GROUP BY sheet_id)
SELECT a.sheet_id, {srnd('r', 6)} AS avg_null_rate, CAST(0 AS BIGINT) AS errors, coalesce(n, 0) AS warnings,
  {srnd('greatest(0e0, least(100e0, (100e0 - coalesce(n, 0) * 8) * (1 - r)))', 4)} AS content_quality_score
FROM a LEFT JOIN w ON w.sheet_id = a.sheet_id""")
def _(spark, d):
    facts = va.content_facts(order_cells(spark, d))
    s = va.content_score(va.findings_from_facts(facts), facts)
    return rnd(rnd(s, 4, "content_quality_score"), 6, "avg_null_rate")


# ------------------------------------------------------------- declared rules

def _rule_sql(source: str, with_: str, rules) -> str:
    parts = [
        f"SELECT sheet_id, 'rules' AS step, 'error' AS severity, '{s}' AS subject, '{c}' AS code, "
        f"CAST(count(*) FILTER (WHERE {bad}) AS VARCHAR) AS detail FROM {source} GROUP BY sheet_id "
        f"HAVING count(*) FILTER (WHERE {bad}) > 0" for s, c, bad in rules]
    return f"WITH {with_}\n" + "\nUNION ALL ".join(parts)


@query("rule_required", _rule_sql("ords", ORDERS, [
    ("o_orderpriority", "required", "o_orderpriority IS NULL OR o_orderpriority = ''"),
    ("o_ref", "required", "o_ref IS NULL OR o_ref = ''"),
    ("waybill", "required", "TRUE"), ("o_custkey", "required", "o_custkey IS NULL")]))
def _(spark, d):
    return va.rule_required(order_sheets(spark, d), ["o_orderpriority", "o_ref", "waybill", "o_custkey"],
                            "sheet_id")


@query("rule_types", _rule_sql("ords", ORDERS, [
    ("o_ref", "not_numeric", "o_ref <> '' AND TRY_CAST(o_ref AS DOUBLE) IS NULL"),
    ("o_orderdate", "not_date", "TRY_CAST(o_orderdate AS DATE) IS NULL"),
    ("o_orderpriority", "not_integer", "o_orderpriority <> '' AND TRY_CAST(o_orderpriority AS BIGINT) IS NULL")]))
def _(spark, d):
    return va.rule_types(order_sheets(spark, d), {
        "o_ref": "numeric", "o_orderdate": "date", "o_orderpriority": "integer"}, "sheet_id")


@query("rule_range", _rule_sql("lines", LINES, [
    ("l_quantity", "out_of_range", "l_quantity < 5e0 OR l_quantity > 45e0"),
    ("l_tax", "out_of_range", "l_tax > 0.07e0"), ("l_discount", "out_of_range", "l_discount < 0.02e0")]))
def _(spark, d):
    return va.rule_range(lines(spark, d), {"l_quantity": (5, 45), "l_tax": (None, 0.07),
                                           "l_discount": (0.02, None)}, "sheet_id")


@query("rule_pattern", _rule_sql("ords", ORDERS, [
    ("o_orderpriority", "pattern", "NOT regexp_matches(o_orderpriority, '^[1-3]-')"),
    ("o_orderdate", "pattern", "NOT regexp_matches(o_orderdate, '^199[0-9]')"),
    ("o_custkey", "pattern", "NOT regexp_matches(CAST(o_custkey AS VARCHAR), '^[0-9]{3,}$')")]))
def _(spark, d):
    return va.rule_pattern(order_sheets(spark, d), {
        "o_orderpriority": "^[1-3]-", "o_orderdate": "^199[0-9]", "o_custkey": "^[0-9]{3,}$"}, "sheet_id")


@query("rule_custom", _rule_sql("lines", LINES, [
    ("discount_below_tax", "custom", "NOT coalesce(l_discount < l_tax, FALSE)"),
    ("price_per_piece", "custom", "NOT coalesce(l_extendedprice / l_quantity > 900, FALSE)")]))
def _(spark, d):
    return va.rule_custom(lines(spark, d), {
        "discount_below_tax": "l_discount < l_tax",
        "price_per_piece": "l_extendedprice / l_quantity > 900"}, "sheet_id")


# ------------------------------------------------------------- bringing together

#: the order sheets with their JSON-free structure and a mapping by rules
def _validated(spark, d):
    cells = order_cells(spark, d)
    meta = order_sheets(spark, d).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("total_rows"))
    structure = va.row_conformance(order_rows(spark, d), "payload", ["o_custkey", "o_ref"], "o_orderkey")
    return va.validate_all(cells, meta, None, structure)


def order_rows(spark, d):
    """Orders as JSON rows; an empty reference leaves its key out."""
    o = order_sheets(spark, d)
    body = F.to_json(F.struct("o_custkey", F.nullif("o_ref", F.lit("")).alias("o_ref")))
    return o.select("sheet_id", "o_orderkey", body.alias("payload"))


STRUCT = """SELECT sheet_id, 'structure' AS step, 'warning' AS severity, CAST(o_orderkey AS VARCHAR) AS subject,
  'missing_columns' AS code, 'o_ref' AS detail FROM ords WHERE o_ref IS NULL OR o_ref = ''"""
ALL = FACTS + f""",
found AS MATERIALIZED ({CONTENT} UNION ALL {STRUCT}),
marks AS (SELECT sheet_id, step, count(*) AS n FROM found GROUP BY sheet_id, step),
scores AS (SELECT sheet_id, 'structure' AS step, CAST(100 AS DOUBLE) - 5 * coalesce((SELECT n FROM marks k
    WHERE k.sheet_id = f.sheet_id AND k.step = 'structure'), 0) AS score FROM (SELECT DISTINCT sheet_id FROM facts) f
  UNION ALL SELECT sheet_id, 'content', (100e0 - 8 * coalesce((SELECT n FROM marks k
    WHERE k.sheet_id = f.sheet_id AND k.step = 'content'), 0)) * (1 - avg(null_rate)) FROM facts f GROUP BY sheet_id),
steps AS (SELECT s.sheet_id, s.step, TRUE AS is_valid, CAST(0 AS BIGINT) AS errors, coalesce(n, 0) AS warnings,
  greatest(0e0, least(100e0, score)) AS score, CAST(NULL AS VARCHAR) AS recommendation
  FROM scores s LEFT JOIN marks m ON m.sheet_id = s.sheet_id AND m.step = s.step)"""


@query("validate_all", f"WITH {ALL} SELECT sheet_id, step, is_valid, errors, warnings, {srnd('score', 4)} AS score, recommendation FROM steps")
def _(spark, d):
    return rnd(_validated(spark, d)[1], 4, "score")


@query("validate_all_findings", f"WITH {ALL} SELECT * FROM found")
def _(spark, d):
    return _validated(spark, d)[0]


@query("validate_mapping", f"""WITH {match.CHECKED}, k AS (SELECT sheet_id, count(*) FILTER (WHERE severity = 'error') AS e,
  count(*) FILTER (WHERE severity = 'warning') AS w FROM checked GROUP BY sheet_id),
m AS (SELECT sheet_id, count("column") AS n FROM m3 GROUP BY sheet_id)
SELECT m.sheet_id, 'mapping' AS step, coalesce(e, 0) = 0 AS is_valid, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings,
  {srnd('greatest(0e0, least(100e0, (100e0 - coalesce(e, 0) * 30 - coalesce(w, 0) * 10) * (n / 15e0)))', 4)} AS score,
  CASE WHEN e > 0 THEN '字段映射验证失败，请检查映射关系' END AS recommendation
FROM m LEFT JOIN k ON k.sheet_id = m.sheet_id""")
def _(spark, d):
    from sheetloom.operators import mapping as mp
    from sheetloom.plans.lineage import materialize

    m = materialize(match.filled(spark, d))
    checked = mp.mapping_check(m, ENGLISH)
    score = mp.mapping_score(checked, m, ENGLISH).withColumnRenamed("mapping_quality_score", "score")
    return rnd(va.step_results({"mapping": score}), 4, "score")


@query("validation_summary", f"""WITH {ALL} SELECT sheet_id, count(*) AS total_steps, count(*) AS passed_steps,
  CAST(0 AS BIGINT) AS failed_steps, max({srnd('score', 4)}) FILTER (WHERE step = 'structure') AS structure_score,
  max({srnd('score', 4)}) FILTER (WHERE step = 'content') AS content_score, CAST(0 AS BIGINT) AS error_count,
  CAST(sum(warnings) AS BIGINT) AS warning_count, '通过' AS overall_status FROM steps GROUP BY sheet_id""")
def _(spark, d):
    s = va.validation_summary(_validated(spark, d)[1])
    s = s.select("sheet_id", "total_steps", "passed_steps", "failed_steps",
                 F.element_at("quality_scores", "structure").alias("structure_score"),
                 F.element_at("quality_scores", "content").alias("content_score"),
                 "error_count", "warning_count", "overall_status")
    return rnd(s, 4, "structure_score", "content_score")


@query("run_checks", f"""WITH {FACTS} SELECT 'content' AS "check", * FROM ({CONTENT}) x
UNION ALL SELECT 'required' AS "check", sheet_id, 'rules', 'error', 'o_orderpriority', 'required',
  CAST(count(*) FILTER (WHERE o_orderpriority IS NULL) AS VARCHAR) FROM ords GROUP BY sheet_id
UNION ALL SELECT 'no_such_check', NULL, 'dispatch', 'error', 'no_such_check', 'unknown_check', 'no such check'""")
def _(spark, d):
    checks = {
        "content": lambda: va.content_check(order_cells(spark, d)),
        "required": lambda: va.rule_required(order_sheets(spark, d), ["o_orderpriority"], "sheet_id"),
    }
    return va.run_checks(checks, ["content", "required", "no_such_check"], spark)


# -------------------------------------------------------------------- reporting

MET = f"met AS MATERIALIZED ({METRICS_SQL})"
_EVEN = PROFILE_SQL["consistency"]


def _metrics(spark, d):
    return pr.quality_metrics(lines(spark, d), "sheet_id")


def _parts(spark, d):
    """Metrics of the order sheets: columns, overall completeness, consistency."""
    o = order_sheets(spark, d)
    m = pr.quality_metrics(o.drop("o_orderkey"), "sheet_id")
    return m, pr.completeness_overall(o.drop("o_orderkey"), "sheet_id"), pr.consistency(order_cells(spark, d))


_OC = ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_ref"]
RECO = ORDERS + ",\nmet AS (" + "\nUNION ALL ".join(
    f"SELECT sheet_id, '{c}' AS subject, {srnd(f'CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100', 2)} AS np, "
    f"{srnd(f'CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) * 100', 2)} AS up FROM ords GROUP BY sheet_id" for c in _OC) + """),
total AS (SELECT sheet_id, """ + srnd("CAST(" + " + ".join(f"count({c})" for c in _OC) + ") AS DOUBLE) / (count(*) * 5) * 100".replace(")) AS DOUBLE", ") AS DOUBLE"), 2).replace("CAST(count", "CAST((count", 1) + """ AS overall
  FROM ords GROUP BY sheet_id),
even AS (""" + _EVEN.replace(f"WITH {CELLS},", "WITH " + CELLS[len(ORDERS) + 2:] + ",", 1) + """),
adv AS (SELECT sheet_id, subject, 'high_null' AS code, np AS value FROM met WHERE np > 50
  UNION ALL SELECT sheet_id, subject, 'low_unique', up FROM met WHERE up < 5
  UNION ALL SELECT sheet_id, 'sheet', 'low_completeness', overall FROM total WHERE overall < 80
  UNION ALL SELECT sheet_id, "column", 'low_consistency', overall_consistency FROM even WHERE overall_consistency < 0.7e0)"""


@query("recommendations", f"""WITH {RECO} SELECT * FROM adv
UNION ALL SELECT sheet_id, 'sheet', 'good', NULL FROM total WHERE sheet_id NOT IN (SELECT sheet_id FROM adv)""")
def _(spark, d):
    return va.recommendations(*_parts(spark, d))


#: sheets of customers are flawless, so the default advice is all there is
@query("recommendations_default", "SELECT DISTINCT c_mktsegment AS sheet_id, 'sheet' AS subject, 'good' AS code, "
       "CAST(NULL AS DOUBLE) AS value FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("sheet_id"), "c_custkey", "c_name", "c_acctbal")
    from sheetloom.operators.reshape import to_cells

    data = c.select("sheet_id", "c_name", "c_acctbal")
    return va.recommendations(
        pr.quality_metrics(data, "sheet_id"), pr.completeness_overall(data, "sheet_id"),
        pr.consistency(to_cells(c, "c_custkey", "sheet_id")))


@query("traffic_lights", f"""WITH {LINES},\n{MET} SELECT sheet_id, "column", null_percentage, unique_percentage,
  CASE WHEN null_percentage > 30 THEN 'warning' ELSE 'success' END AS null_light,
  CASE WHEN unique_percentage < 10 THEN 'warning' ELSE 'success' END AS unique_light FROM met""")
def _(spark, d):
    return va.traffic_lights(_metrics(spark, d))


_GRADE = ("CASE WHEN score >= 90 THEN '优秀' WHEN score >= 80 THEN '良好' WHEN score >= 70 THEN '一般' "
          "WHEN score >= 60 THEN '较差' ELSE '很差' END")


@query("quality_grade", f"SELECT event_id, value AS score, {_GRADE.replace('score', 'value')} AS grade FROM events")
def _(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("value").alias("score"))
    return va.quality_grade(ev)


@query("composite_score", """SELECT l_returnflag AS sheet_id, floor((avg(l_discount) * 25 + avg(l_tax) * 25
  + avg(l_quantity / 50e0) * 25 + 1 * 25) * 1e4 + 0.5e0) / 1e4 AS composite FROM lineitem GROUP BY l_returnflag""")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("sheet_id")).agg(
        F.avg("l_discount").alias("completeness"), F.avg("l_tax").alias("consistency"),
        F.avg(F.col("l_quantity") / 50.0).alias("accuracy"), F.max(F.lit(1)).alias("mapping"))
    return rnd(va.composite_score(s), 4, "composite").select("sheet_id", "composite")


_PRESENT = " + ".join(f"({c} IS NOT NULL)::INT" for c in _OC)


@query("quality_report", f"""WITH {RECO},
advice AS (SELECT * FROM adv UNION ALL SELECT sheet_id, 'sheet', 'good', NULL FROM total WHERE sheet_id NOT IN (SELECT sheet_id FROM adv)),
listed AS (SELECT sheet_id, string_agg(subject || ':' || code, ',' ORDER BY subject, code) AS recommendations FROM advice GROUP BY sheet_id),
pct AS (SELECT sheet_id, {srnd(f'CAST({_PRESENT} AS DOUBLE) / 5e0 * 100', 2)} AS p FROM ords),
spread AS (SELECT sheet_id, min(p) AS row_min, max(p) AS row_max, {srnd('avg(p)', 2)} AS row_mean,
  {srnd('stddev_pop(p)', 2)} AS row_std FROM pct GROUP BY sheet_id)
SELECT total.sheet_id, overall AS completeness, 5 AS metric_columns, 5 AS analysed_columns, 5 AS compared_columns,
  recommendations, row_min, row_max, row_mean, row_std
FROM total JOIN listed ON listed.sheet_id = total.sheet_id JOIN spread ON spread.sheet_id = total.sheet_id""")
def _(spark, d):
    report = nested_report(quality_report(order_sheets(spark, d), "sheet_id", "o_orderkey"))
    advice = F.array_sort(F.transform("recommendations", lambda r: F.concat_ws(
        ":", F.get_json_object(r, "$.subject"), F.get_json_object(r, "$.code"))))
    return report.select(
        "sheet_id", "completeness", F.size("quality_metrics").alias("metric_columns"),
        F.size("field_analysis").alias("analysed_columns"),
        F.size("consistency").alias("compared_columns"),
        F.array_join(advice, ",").alias("recommendations"),
        *[F.col("row_stats")[k].alias(f"row_{k}") for k in ("min", "max", "mean", "std")])

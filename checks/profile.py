"""Column profiling and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    CELLS,
    CLASSIFIED,
    DATE_WORDS,
    ID_WORDS,
    LINE_COLS,
    LINE_NUM,
    LINES,
    NAME_WORDS,
    PRICE_WORDS,
    PROFILES,
    QTY_WORDS,
    any_of,
    corpus_frames,
    in_list,
    lines,
    order_cells,
    profiles,
    rnd,
    srnd,
    table,
)
from sheetloom import dictionary as fixed
from sheetloom.operators import classify as cl
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


def per_line_col(expr: str, extra: str = "") -> str:
    """UNION ALL of one aggregate per line column; {c} is the column."""
    parts = [
        f"SELECT sheet_id, '{c}' AS \"column\", {i} AS position, {expr.format(c=c)} "
        f"FROM lines GROUP BY sheet_id"
        for i, c in enumerate(LINE_COLS)
    ]
    return f"WITH {LINES}\n" + "\nUNION ALL ".join(parts)


PCT = lambda e: srnd(e, 2)


@query("null_profile", per_line_col(
    "count(*) AS total_rows, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
    "CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_rate, "
    + srnd("CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100", 2) + " AS null_percentage"))
def _(spark, d):
    return pr.null_profile(lines(spark, d), "sheet_id")


@query("uniqueness", per_line_col(
    "count(*) AS total_rows, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, "
    "CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) AS uniqueness"))
def _(spark, d):
    return pr.uniqueness(lines(spark, d), "sheet_id")


@query("uniqueness_sketch")
def _(spark, d):
    return pr.uniqueness(lines(spark, d), "sheet_id", exact=False)


#: the sketch stays within three times its stated error of 5 %
@query("uniqueness_sketch_error", per_line_col("count(*) AS total_rows, count({c}) AS non_null, TRUE AS within"))
def _(spark, d):
    sketch = pr.uniqueness(lines(spark, d), "sheet_id", exact=False)
    exact = pr.uniqueness(lines(spark, d), "sheet_id").select("sheet_id", "column", F.col("distinct_count").alias("n"))
    both = sketch.join(exact, ["sheet_id", "column"])
    return both.select("sheet_id", "column", "position", "total_rows", "non_null",
                       (F.abs(F.col("distinct_count") - F.col("n")) <= 3 * 0.05 * F.col("n")).alias("within"))


@query("duplication_rate", per_line_col(
    "count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, "
    "1e0 - CAST(count(DISTINCT {c}) AS DOUBLE) / count({c}) AS duplication_rate"))
def _(spark, d):
    return pr.duplication_rate(lines(spark, d), "sheet_id")


_TYPE = ("CASE WHEN count(*) FILTER (WHERE kind <> 'null') = 0 THEN 'text' "
         "WHEN count(*) FILTER (WHERE kind IN ('int', 'float')) = count(*) FILTER (WHERE kind <> 'null') "
         "THEN 'numeric' WHEN count(*) FILTER (WHERE kind = 'text' AND length(raw) = 10) "
         "= count(*) FILTER (WHERE kind <> 'null') THEN 'date' ELSE 'text' END")


@query("infer_column_type", f"""WITH {CELLS}
SELECT sheet_id, "column", count(*) FILTER (WHERE kind <> 'null') AS non_null, {_TYPE} AS data_type
FROM cells GROUP BY sheet_id, "column" """)
def _(spark, d):
    return pr.infer_column_type(order_cells(spark, d))


@query("numeric_stats", f"WITH {LINES}\n" + "\nUNION ALL ".join(
    f"SELECT sheet_id, '{c}' AS \"column\", {i} AS position, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max, {srnd(f'avg({c})', 4)} AS mean, "
    f"{srnd(f'stddev_samp({c})', 4)} AS std FROM lines GROUP BY sheet_id"
    for i, c in enumerate(LINE_NUM)))
def _(spark, d):
    return rnd(pr.numeric_stats(lines(spark, d), "sheet_id"), 4, "mean", "std")


_BYTES = {"l_linestatus": "octet_length(CAST(l_linestatus AS BLOB))",
          "l_shipdate": "octet_length(CAST(l_shipdate AS BLOB))", "l_linenumber": "4"}
_DECL = {"l_linestatus": "string", "l_shipdate": "string", "l_linenumber": "int",
         "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint"}


@query("basic_stats", f"WITH {LINES}\n" + "\nUNION ALL ".join(
    f"SELECT sheet_id, '{c}' AS \"column\", {i} AS position, count(*) AS total_rows, "
    f"{len(LINE_COLS)} AS total_columns, '{_DECL.get(c, 'double')}' AS declared_type, "
    f"CAST(coalesce(sum({_BYTES.get(c, '8')}) FILTER (WHERE {c} IS NOT NULL), 0) AS BIGINT) AS value_bytes "
    f"FROM lines GROUP BY sheet_id"
    for i, c in enumerate(LINE_COLS)))
def _(spark, d):
    return pr.basic_stats(lines(spark, d), "sheet_id")


def _metrics_sql(c: str, i: int) -> str:
    num = c in LINE_NUM
    stat = lambda e, r=False: (srnd(e, 4) if r else f"CAST({e} AS DOUBLE)") if num else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT sheet_id, '{c}' AS \"column\", {i} AS position, count(*) AS total_rows, "
        f"count(*) - count({c}) AS null_count, "
        f"{srnd(f'CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100', 2)} AS null_percentage, "
        f"count(DISTINCT {c}) AS unique_count, "
        f"{srnd(f'CAST(count(DISTINCT {c}) AS DOUBLE) / count(*) * 100', 2)} AS unique_percentage, "
        f"'{_DECL.get(c, 'double')}' AS data_type, {stat(f'min({c})')} AS min, {stat(f'max({c})')} AS max, "
        f"{stat(f'avg({c})', True)} AS mean, {stat(f'stddev_samp({c})', True)} AS std "
        f"FROM lines GROUP BY sheet_id")


METRICS_SQL = "\nUNION ALL ".join(_metrics_sql(c, i) for i, c in enumerate(LINE_COLS))


@query("quality_metrics", f"WITH {LINES}\n{METRICS_SQL}")
def _(spark, d):
    return rnd(pr.quality_metrics(lines(spark, d), "sheet_id"), 4, "mean", "std")


_FILLED = " + ".join(f"count({c})" for c in LINE_COLS)


@query("completeness_overall", f"""WITH {LINES}
SELECT sheet_id, {_FILLED} AS filled, count(*) * {len(LINE_COLS)} AS cells,
       {srnd(f'CAST({_FILLED} AS DOUBLE) / (count(*) * {len(LINE_COLS)}) * 100', 2)} AS overall
FROM lines GROUP BY sheet_id""")
def _(spark, d):
    return pr.completeness_overall(lines(spark, d), "sheet_id")


_ROWPCT = srnd("CAST(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in LINE_COLS)
               + f" AS DOUBLE) / {len(LINE_COLS)}e0 * 100", 2)


@query("completeness_rows", f"""WITH {LINES}, pct AS (SELECT sheet_id, {_ROWPCT} AS p FROM lines)
SELECT sheet_id, min(p) AS min, max(p) AS max, {srnd('avg(p)', 2)} AS mean, {srnd('stddev_pop(p)', 2)} AS std
FROM pct GROUP BY sheet_id""")
def _(spark, d):
    return pr.completeness_rows(lines(spark, d), "sheet_id")


@query("completeness_columns", per_line_col(
    srnd("CAST(count({c}) AS DOUBLE) / count(*) * 100", 2) + " AS completeness"))
def _(spark, d):
    return pr.completeness_columns(lines(spark, d), "sheet_id")


_FIRST = """firsts AS (SELECT sheet_id, "column", arg_min(kind, row_no) AS first_kind
  FROM cells GROUP BY sheet_id, "column")"""


@query("type_consistency", f"""WITH {CELLS}, {_FIRST}
SELECT c.sheet_id, c."column", f.first_kind,
  {srnd('CAST(count(*) FILTER (WHERE c.kind = f.first_kind) AS DOUBLE) / count(*)', 3)} AS type_consistency
FROM cells c JOIN firsts f ON c.sheet_id = f.sheet_id AND c."column" = f."column"
GROUP BY c.sheet_id, c."column", f.first_kind""")
def _(spark, d):
    return pr.type_consistency(order_cells(spark, d))


_FORMAT = "1e0 / (1e0 + var_pop(length({v})) / (avg(length({v})) + 1e0))"


@query("format_consistency", """SELECT source AS sheet_id, 'text' AS "column", 0 AS position, """
       + srnd(_FORMAT.format(v="text"), 3) + """ AS format_consistency FROM documents GROUP BY source
UNION ALL SELECT source, 'lang', 1, """ + srnd(_FORMAT.format(v="nullif(lang, 'fr')"), 3)
       + """ FROM documents GROUP BY source
UNION ALL SELECT source, 'n_chars', 2, 1e0 FROM documents GROUP BY source""")
def _(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("source").alias("sheet_id"), "text", F.nullif("lang", F.lit("fr")).alias("lang"),
        "n_chars")
    return pr.format_consistency(docs, "sheet_id")


@query("consistency", f"""WITH {CELLS}, {_FIRST}, m AS (
SELECT c.sheet_id, c."column",
  CAST(count(*) FILTER (WHERE c.kind = f.first_kind) AS DOUBLE) / count(*) AS t,
  CASE WHEN count(*) FILTER (WHERE c.kind IN ('text', 'bool')) > 0 THEN
  {_FORMAT.format(v='raw')} ELSE 1e0 END AS f
FROM cells c JOIN firsts f ON c.sheet_id = f.sheet_id AND c."column" = f."column"
GROUP BY c.sheet_id, c."column")
SELECT sheet_id, "column", {srnd('t', 3)} AS type_consistency, {srnd('f', 3)} AS format_consistency,
  {srnd('(t + f) / 2', 3)} AS overall_consistency FROM m""")
def _(spark, d):
    return pr.consistency(order_cells(spark, d))


_KINDS = "string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE kind <> 'null')"


@query("mixed_types", f"""WITH {CELLS}
SELECT sheet_id, "column", {_KINDS} AS kinds FROM cells GROUP BY sheet_id, "column"
HAVING count(DISTINCT kind) FILTER (WHERE kind <> 'null') > 1""")
def _(spark, d):
    return pr.mixed_types(order_cells(spark, d)).withColumn("kinds", F.array_join("kinds", ","))


@query("numeric_columns", f"""WITH {CELLS}
SELECT sheet_id, "column", count(*) FILTER (WHERE kind IN ('int', 'float')) AS numbers
FROM cells GROUP BY sheet_id, "column" HAVING count(*) FILTER (WHERE kind IN ('int', 'float')) > 0""")
def _(spark, d):
    return pr.numeric_columns(order_cells(spark, d))


#: squared and cubed amounts have the long tail that three deviations need
def skewed_events(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        F.col("event_type").alias("sheet_id"), "event_id", v.alias("amount"),
        (v * v * v).alias("cube"), F.nullif("user_id", F.lit(7)).alias("user_id"))


SKEWED = """ev AS (SELECT event_type AS sheet_id, event_id, value AS amount, value * value * value AS cube,
  nullif(user_id, 7) AS user_id FROM events)"""
_OUT_COLS = ("amount", "cube", "user_id")
OUTLIERS = SKEWED + """, st AS (SELECT sheet_id, """ + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _OUT_COLS) + """ FROM ev GROUP BY sheet_id),
outl AS (""" + "\nUNION ALL ".join(
    f"SELECT ev.sheet_id, event_id, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, m_{c} AS mean, s_{c} AS std "
    f"FROM ev JOIN st ON ev.sheet_id = st.sheet_id WHERE abs({c} - m_{c}) > 3e0 * s_{c}"
    for c in _OUT_COLS) + ")"


@query("outliers_3sigma", f"""WITH {OUTLIERS}
SELECT sheet_id, event_id, "column", value, {srnd('mean', 4)} AS mean, {srnd('std', 4)} AS std FROM outl""")
def _(spark, d):
    return rnd(pr.outliers_3sigma(skewed_events(spark, d), "event_id", "sheet_id"), 4, "mean", "std")


@query("outliers_3sigma_whole", """WITH ev AS (SELECT event_id, value * value * value AS cube FROM events),
st AS (SELECT avg(cube) AS mean, stddev_pop(cube) AS std FROM ev)
SELECT event_id, 'cube' AS "column", cube AS value, """ + srnd("mean", 2) + " AS mean, " + srnd("std", 2)
       + " AS std FROM ev, st WHERE abs(cube - mean) > 3e0 * std")
def _(spark, d):
    ev = skewed_events(spark, d).select("event_id", "cube")
    return rnd(pr.outliers_3sigma(ev, "event_id"), 2, "mean", "std")


@query("outlier_samples", f"""WITH {OUTLIERS}, r AS (SELECT *, row_number() OVER (
  PARTITION BY sheet_id, "column" ORDER BY event_id) AS rank FROM outl)
SELECT sheet_id, event_id, "column", value, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def _(spark, d):
    out = pr.outliers_3sigma(skewed_events(spark, d), "event_id", "sheet_id")
    return pr.outlier_samples(out, "event_id", "sheet_id").drop("mean", "std")


@query("integer_share", f"""WITH {CELLS}, n AS (SELECT sheet_id, "column", CAST(raw AS DOUBLE) AS v FROM cells
  WHERE kind IN ('int', 'float'))
SELECT sheet_id, "column", count(*) AS numbers, count(*) FILTER (WHERE v = floor(v)) AS whole,
  CAST(count(*) FILTER (WHERE v = floor(v)) AS DOUBLE) / count(*) AS integer_share
FROM n GROUP BY sheet_id, "column" """)
def _(spark, d):
    return pr.integer_share(order_cells(spark, d))


_P = ('sheet_id, "column", position, total_rows, non_null, null_rate, distinct_count, uniqueness, '
      "data_type")


@query("profile_columns", f"WITH {PROFILES} SELECT {_P} FROM profiles WHERE sheet_id LIKE 'lineitem/%'")
def _(spark, d):
    return pr.profile_columns(corpus_frames(spark, d)[1], "sheet_id")


@query("profile_corpus", f"WITH {PROFILES} SELECT {_P} FROM profiles")
def _(spark, d):
    return profiles(spark, d)


@query("profile_cells", f"""WITH {CELLS}
SELECT sheet_id, "column", col_no AS position, count(*) AS total_rows,
  count(*) FILTER (WHERE raw <> '') AS non_null,
  CAST(count(*) FILTER (WHERE raw IS NULL OR raw = '') AS DOUBLE) / count(*) AS null_rate,
  count(DISTINCT raw) FILTER (WHERE raw <> '') AS distinct_count,
  CAST(count(DISTINCT raw) FILTER (WHERE raw <> '') AS DOUBLE) / count(*) AS uniqueness,
  {_TYPE} AS data_type FROM cells GROUP BY sheet_id, "column", col_no""")
def _(spark, d):
    return pr.profile_cells(order_cells(spark, d))


# -------------------------------------------------------------- classification


@query("classify", f'WITH {CLASSIFIED} SELECT sheet_id, "column", category FROM classified')
def _(spark, d):
    return cl.classify(profiles(spark, d)).select("sheet_id", "column", "category")


_N = 'lower("column")'
_FTYPE = (f"CASE WHEN {any_of(_N, DATE_WORDS)} THEN 'date' WHEN {any_of(_N, ID_WORDS)} THEN 'identifier' "
          f"WHEN {any_of(_N, QTY_WORDS)} THEN 'quantity' WHEN {any_of(_N, NAME_WORDS)} THEN 'name' "
          f"WHEN {any_of(_N, PRICE_WORDS)} THEN 'price' ELSE 'unknown' END")
_g = lambda cond, w: f"CASE WHEN {cond} THEN {w}e0 ELSE 0e0 END"
_IMP = "least(1e0, " + " + ".join(
    [_g(any_of(_N, words), w) for words, w in fixed.IMPORTANCE_WORDS]
    + [_g("null_rate < 0.1e0", 0.1), _g("null_rate < 0.5e0", 0.05),
       _g("uniqueness > 0.1e0 AND uniqueness < 0.9e0", 0.1)]) + ")"
_KW = ("array_to_string(list_filter([" + in_list(fixed.FEATURE_KEYWORDS)
       + f"], lambda k: contains({_N}, k)), ',')")


@query("infer_field_type", f'WITH {PROFILES} SELECT sheet_id, "column", {_FTYPE} AS inferred_type FROM profiles')
def _(spark, d):
    return cl.infer_field_type(profiles(spark, d)).select("sheet_id", "column", "inferred_type")


@query("importance", f'WITH {PROFILES} SELECT sheet_id, "column", {srnd(_IMP, 6)} AS importance_score FROM profiles')
def _(spark, d):
    return rnd(cl.importance(profiles(spark, d)), 6, "importance_score").select(
        "sheet_id", "column", "importance_score")


@query("extract_keywords", f'WITH {PROFILES} SELECT sheet_id, "column", {_KW} AS keywords FROM profiles')
def _(spark, d):
    return cl.extract_keywords(profiles(spark, d)).select(
        "sheet_id", "column", F.array_join("keywords", ",").alias("keywords"))


@query("field_features", f"""WITH {PROFILES} SELECT sheet_id, "column", position, {_FTYPE} AS inferred_type,
  {srnd(_IMP, 6)} AS importance_score, {_KW} AS keywords FROM profiles""")
def _(spark, d):
    return rnd(cl.field_features(profiles(spark, d)), 6, "importance_score").withColumn(
        "keywords", F.array_join("keywords", ","))

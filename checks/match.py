"""Matching columns to standard fields, and what is done with the mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    CLASSIFIED, PROFILES, any_of, classified, dbl, in_list, profiles, rnd, srnd, table,
)
from sheetloom.dictionary import ENGLISH, literal_tokens, normalize_literal
from sheetloom.operators import mapping as mp
from sheetloom.operators import matching as mt
from sheetloom.plans import onboarding
from sheetloom.plans.lineage import materialize

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


FIELDS = ENGLISH.fields
N = len(FIELDS)
NAME = 'lower("column")'

# ------------------------------------------------------------------ rule scores


def _alt(alt) -> str:
    return " AND ".join(any_of(NAME, g) for g in alt.groups)


def _gain(field) -> str:
    def term(alts):
        return "CASE " + " ".join(f"WHEN {_alt(a)} THEN {dbl(a.weight)}" for a in alts) + " ELSE 0e0 END"

    def cond(c):
        col, op, value, weight = c
        literal = dbl(value) if isinstance(value, float) else f"'{value}'"
        return f"CASE WHEN {col} {op} {literal} THEN {dbl(weight)} ELSE 0e0 END"

    terms = [term(t) for t in field.terms]
    conds = [cond(c) for c in field.conditions]
    order = [terms[0], *conds, *terms[1:]] if field.counts_totals else [*terms, *conds]
    return " + ".join(["0e0", *order])


def _per_field(source: str, value, alias: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT sheet_id, \"column\", position AS col_pos, '{f.name}' AS std_field, {i} AS std_pos, "
        f"{value(f)} AS {alias} FROM {source}" for i, f in enumerate(FIELDS))


RULES = CLASSIFIED + ",\nrules AS MATERIALIZED (" + _per_field("classified", _gain, "score") + ")"


@query("rule_scores", f"""WITH {RULES} SELECT sheet_id, "column", col_pos, std_field, std_pos,
  {srnd('score', 6)} AS score FROM rules""")
def _(spark, d):
    return rnd(mt.rule_scores(classified(spark, d), ENGLISH), 6, "score")


# -------------------------------------------------------------- name similarity

NORM = r"""trim(regexp_replace(regexp_replace(lower("column"), '[_\-./\\]+', ' ', 'g'), '\s+', ' ', 'g'))"""
NAMED = PROFILES + f""",
named AS MATERIALIZED (SELECT *, {NORM} AS norm_name,
  list_distinct(regexp_extract_all({NORM}, '[a-z0-9]+')) AS tokens FROM profiles)"""


@query("normalize_names", f'WITH {NAMED} SELECT sheet_id, "column", norm_name FROM named')
def _(spark, d):
    return mt.normalize_names(profiles(spark, d)).select("sheet_id", "column", "norm_name")


@query("normalize_names_exact", f'WITH {NAMED} SELECT sheet_id, "column", norm_name FROM named')
def _(spark, d):
    return mt.normalize_names(profiles(spark, d), exact=True).select(
        "sheet_id", "column", "norm_name")


@query("token_index", f'WITH {NAMED} SELECT sheet_id, "column", unnest(tokens) AS token FROM named')
def _(spark, d):
    return mt.token_index(profiles(spark, d))


def _edit(field) -> str:
    lit = normalize_literal(field.name)
    return (f"CASE WHEN norm_name = '' THEN 0e0 ELSE 1e0 - CAST(levenshtein(norm_name, '{lit}') AS DOUBLE) "
            f"/ greatest(length(norm_name), {len(lit)}) END")


def _over(field) -> str:
    words = literal_tokens(field.name)
    lst = "[" + in_list(words) + "]"
    shared = f"len(list_intersect(tokens, {lst}))"
    return (f"CASE WHEN len(tokens) = 0 THEN 0e0 ELSE CAST({shared} AS DOUBLE) "
            f"/ (len(tokens) + {len(words)} - {shared}) END")


def _hint(field) -> str:
    parts = ["0e0"]
    if field.unit_hints:
        parts.append(f"CASE WHEN {any_of('norm_name', field.unit_hints)} THEN 0.2e0 ELSE 0e0 END")
    if field.counts_totals:
        parts.append(f"CASE WHEN {any_of('norm_name', ENGLISH.total_hints)} THEN 0.2e0 ELSE 0e0 END")
    return f"least(0.4e0, {' + '.join(parts)})"


@query("edit_similarity", f"""WITH {NAMED}, e AS ({_per_field('named', _edit, 'edit_sim')})
SELECT sheet_id, "column", std_field, {srnd('edit_sim', 6)} AS edit_sim FROM e""")
def _(spark, d):
    pairs = mt.hint_bonus(profiles(spark, d), ENGLISH)
    return rnd(mt.edit_similarity(pairs), 6, "edit_sim").select(
        "sheet_id", "column", "std_field", "edit_sim")


@query("token_overlap", f"""WITH {NAMED}, e AS ({_per_field('named', _over, 'overlap')})
SELECT sheet_id, "column", col_pos, std_field, std_pos, {srnd('overlap', 6)} AS overlap FROM e""")
def _(spark, d):
    return rnd(mt.token_overlap(profiles(spark, d), ENGLISH), 6, "overlap")


@query("hint_bonus", f"""WITH {NAMED}, e AS ({_per_field('named', _hint, 'bonus')})
SELECT sheet_id, "column", col_pos, std_field, std_pos, bonus FROM e""")
def _(spark, d):
    return mt.hint_bonus(profiles(spark, d), ENGLISH)


def _blend(f) -> str:
    return f"(0.6e0 * ({_edit(f)}) + 0.4e0 * ({_over(f)})) + {_hint(f)}"


SIMS = NAMED + ",\nsims AS MATERIALIZED (" + _per_field("named", _blend, "score") + ")"


@query("similarity_scores", f"""WITH {SIMS} SELECT sheet_id, "column", col_pos, std_field, std_pos,
  {srnd('score', 6)} AS score FROM sims""")
def _(spark, d):
    return rnd(mt.similarity_scores(profiles(spark, d), ENGLISH), 6, "score")


# ------------------------------------------------------------------- assignment


@query("top_matches", f"""WITH {SIMS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sheet_id, std_pos
  ORDER BY score DESC, col_pos) AS INT) AS rank FROM sims)
SELECT sheet_id, "column", std_field, {srnd('score', 6)} AS score, rank FROM r WHERE rank <= 3""")
def _(spark, d):
    top = mt.top_matches(mt.similarity_scores(profiles(spark, d), ENGLISH), 3)
    return rnd(top, 6, "score").select("sheet_id", "column", "std_field", "score", "rank")


SHEETS = "sheets AS (SELECT DISTINCT sheet_id FROM profiles)"
STD = "std(std_field, std_pos) AS (VALUES " + ", ".join(
    f"('{f.name}', {i})" for i, f in enumerate(FIELDS)) + ")"


def chain(prefix: str, scores: str, accept: str, used0: str, guard: str = "TRUE") -> str:
    """One step per standard field: best unused column, then marked as used."""
    out = [f"{prefix}0 AS MATERIALIZED ({used0})"]
    for i in range(N):
        out.append(
            f"{prefix}{i + 1} AS MATERIALIZED (SELECT * FROM {prefix}{i} UNION ALL "
            f"SELECT sheet_id, \"column\", {i} AS std_pos, score FROM (SELECT s.*, row_number() OVER ("
            f"PARTITION BY s.sheet_id ORDER BY s.score DESC, s.col_pos) AS rn FROM {scores} s "
            f"WHERE s.std_pos = {i} AND s.score > 0 AND {guard} AND NOT EXISTS (SELECT 1 FROM {prefix}{i} u "
            f"WHERE u.sheet_id = s.sheet_id AND u.\"column\" = s.\"column\")) b "
            f"WHERE rn = 1 AND score {accept})")
    return ",\n".join(out)


NOTHING = ("SELECT CAST(NULL AS VARCHAR) AS sheet_id, CAST(NULL AS VARCHAR) AS \"column\", "
           "CAST(NULL AS INT) AS std_pos, CAST(NULL AS DOUBLE) AS score WHERE FALSE")


def spread(name: str, chosen: str, stage: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT h.sheet_id, d.std_field, d.std_pos, c.\"column\", "
            f"CASE WHEN c.\"column\" IS NOT NULL THEN '{stage}' END AS stage, c.score "
            f"FROM sheets h CROSS JOIN std d LEFT JOIN {chosen} c "
            f"ON c.sheet_id = h.sheet_id AND c.std_pos = d.std_pos)")


GREEDY = ",\n".join([RULES, SHEETS, STD, chain("u", "rules", "> 0.3e0", NOTHING),
                     spread("m1", f"u{N}", "rules")])

_M = 'sheet_id, std_field, std_pos, "column", stage'


@query("assign_greedy", f"WITH {GREEDY} SELECT {_M}, {srnd('score', 6)} AS score FROM m1")
def _(spark, d):
    return rnd(greedy(spark, d), 6, "score")


def greedy(spark, d):
    return mt.assign_greedy(mt.rule_scores(classified(spark, d), ENGLISH), ENGLISH)


def base_profiles(spark, d):
    """Classified profiles, written once for operators that read them twice."""
    return materialize(classified(spark, d))


FILLED_SIM = ",\n".join([
    GREEDY,
    SIMS.split("named AS MATERIALIZED")[1].join(["named AS MATERIALIZED", ""]),
    "open1 AS (SELECT sheet_id, std_pos FROM m1 WHERE \"column\" IS NULL)",
    chain("v", "sims", ">= 0.4e0",
          "SELECT sheet_id, \"column\", std_pos, score FROM m1 WHERE \"column\" IS NOT NULL",
          "EXISTS (SELECT 1 FROM open1 o WHERE o.sheet_id = s.sheet_id AND o.std_pos = s.std_pos)"),
    f"m2 AS MATERIALIZED (SELECT m1.sheet_id, m1.std_field, m1.std_pos, v.\"column\", "
    f"CASE WHEN m1.\"column\" IS NOT NULL THEN 'rules' WHEN v.\"column\" IS NOT NULL THEN 'similarity' END AS stage, "
    f"v.score FROM m1 LEFT JOIN v{N} v ON v.sheet_id = m1.sheet_id AND v.std_pos = m1.std_pos)",
])


@query("fill_by_similarity", f"WITH {FILLED_SIM} SELECT {_M}, {srnd('score', 6)} AS score FROM m2")
def _(spark, d):
    base = base_profiles(spark, d)
    first = mt.assign_greedy(mt.rule_scores(base, ENGLISH), ENGLISH)
    return rnd(mt.fill_by_similarity(first, mt.similarity_scores(base, ENGLISH), ENGLISH), 6, "score")


HITS = "hits AS (" + "\nUNION ALL ".join(
    f"SELECT sheet_id, {i} AS std_pos, arg_min(\"column\", position) AS first_col FROM profiles "
    f"WHERE {any_of('\"column\"', f.keywords)} GROUP BY sheet_id"
    for i, f in enumerate(FIELDS) if f.keywords) + ")"
FILLED_KEY = ",\n".join([
    GREEDY, HITS,
    "m3 AS MATERIALIZED (SELECT m.sheet_id, m.std_field, m.std_pos, coalesce(m.\"column\", h.first_col) AS \"column\", "
    "CASE WHEN m.\"column\" IS NULL AND h.first_col IS NOT NULL THEN 'keywords' ELSE m.stage END AS stage, m.score "
    "FROM m1 m LEFT JOIN hits h ON h.sheet_id = m.sheet_id AND h.std_pos = m.std_pos)",
])


@query("fill_by_keywords", f"WITH {FILLED_KEY} SELECT {_M}, {srnd('score', 6)} AS score FROM m3")
def _(spark, d):
    return rnd(filled(spark, d), 6, "score")


def filled(spark, d):
    """Rules plus keywords: a mapping with shared columns."""
    base = base_profiles(spark, d)
    first = mt.assign_greedy(mt.rule_scores(base, ENGLISH), ENGLISH)
    return mp.fill_by_keywords(first, base, ENGLISH)


# ------------------------------------------------------- replies with proposals

#: one reply per order: fenced JSON, JSON with nested mapping, plain fields, text
#: lines, a rating with text lines
def replies(spark, d):
    o = F.col("o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    who = F.col("o_custkey").cast("string")
    text = (
        F.when(o == "1-URGENT", F.concat(F.lit('My mapping: {"mapping": {"order_key": "k'), key,
                                         F.lit('", "weight": "missing", "carrier": "c'), who,
                                         F.lit('"}} done')))
        .when(o == "2-HIGH", F.concat(F.lit('```json\n{"order_key": "k'), key,
                                      F.lit('", "ship_date": "d"}\n```')))
        .when(o == "3-MEDIUM", F.concat(F.lit("Result\norder_key: k"), key,
                                        F.lit('\ncarrier："c'), who, F.lit('"\nweight: missing\n')))
        .when(o == "4-NOT SPECIFIED", F.concat(F.lit('{"confidence": 80} order_key: "k'), key,
                                               F.lit('"')))
        .otherwise(F.concat(F.lit("nothing found for "), key))
    )
    return table(spark, d, "orders").select(
        F.concat(F.lit("o"), key).alias("sheet_id"), text.alias("text"))


REPLIES = """replies AS (SELECT 'o' || o_orderkey AS sheet_id, o_orderpriority AS p, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'My mapping: {"mapping": {"order_key": "k' || o_orderkey
    || '", "weight": "missing", "carrier": "c' || o_custkey || '"}} done'
  WHEN '2-HIGH' THEN '```json' || chr(10) || '{"order_key": "k' || o_orderkey || '", "ship_date": "d"}'
    || chr(10) || '```'
  WHEN '3-MEDIUM' THEN 'Result' || chr(10) || 'order_key: k' || o_orderkey || chr(10) || 'carrier："c'
    || o_custkey || '"' || chr(10) || 'weight: missing' || chr(10)
  WHEN '4-NOT SPECIFIED' THEN '{"confidence": 80} order_key: "k' || o_orderkey || '"'
  ELSE 'nothing found for ' || o_orderkey END AS text FROM orders)"""


def _sql_text(field: str) -> str:
    v = f"trim(regexp_extract(text, '{field}[：:]\\s*\"?([^\"\\n]+)\"?', 1))"
    return f"nullif(nullif({v}, ''), 'missing')"


def _reply_rows(value, source: str = "bodies") -> str:
    return "\nUNION ALL ".join(
        f"SELECT sheet_id, '{f.name}' AS std_field, {i} AS std_pos, {value(f)} AS \"column\" FROM {source}"
        for i, f in enumerate(FIELDS))


def _json_value(f) -> str:
    def at(path):
        return f"nullif(nullif(json_extract_string(body, '{path}'), ''), 'missing')"
    return (f"CASE WHEN json_type(body, '$.mapping') = 'OBJECT' THEN {at('$.mapping.' + f.name)} "
            f"WHEN list_has_any(json_keys(body), [{in_list(ENGLISH.names)}]) THEN {at('$.' + f.name)} "
            f"ELSE {_sql_text(f.name)} END")


BODIES = REPLIES + r""",
bodies AS (SELECT sheet_id, text, CASE WHEN json_valid(b) THEN b END AS body FROM (
  SELECT *, nullif(regexp_extract(text, '(?s)\{.*\}'), '') AS b FROM replies))"""
PROPOSED = BODIES + ",\nproposed AS (" + _reply_rows(_json_value) + ")"


@query("parse_proposals", f"WITH {PROPOSED} SELECT * FROM proposed")
def _(spark, d):
    return mp.parse_proposals(replies(spark, d), dictionary=ENGLISH)


@query("parse_text_mapping", f"WITH {REPLIES} " + _reply_rows(lambda f: _sql_text(f.name), "replies"))
def _(spark, d):
    return mp.parse_text_mapping(replies(spark, d), dictionary=ENGLISH)


@query("extract_mapping_object", f"""WITH {BODIES}, k AS (SELECT sheet_id, body, unnest(json_keys(body, '$.mapping')) AS std_field
  FROM bodies WHERE contains(lower(text), 'mapping') AND json_type(body, '$.mapping') = 'OBJECT')
SELECT sheet_id, std_field, json_extract_string(body, '$.mapping.' || std_field) AS "column" FROM k""")
def _(spark, d):
    return mp.extract_mapping_object(replies(spark, d))


def sheet_proposals(spark, d):
    """Proposals for the profiled sheets: the first column of a group as carrier."""
    p = profiles(spark, d)
    text = F.concat(F.lit('{"mapping": {"carrier": "'), F.min("column"), F.lit('", "order_key": "'),
                    F.max("column"), F.lit('"}}'))
    return mp.parse_proposals(p.groupBy("sheet_id").agg(text.alias("text")), dictionary=ENGLISH)


SHEET_PROPOSALS = """props AS (SELECT h.sheet_id, d.std_field, d.std_pos,
  CASE d.std_field WHEN 'carrier' THEN h.lo WHEN 'order_key' THEN h.hi END AS "column"
  FROM (SELECT sheet_id, min("column") AS lo, max("column") AS hi FROM profiles GROUP BY sheet_id) h
  CROSS JOIN std d)"""
MERGED = GREEDY + ",\n" + SHEET_PROPOSALS + """,
merged AS MATERIALIZED (SELECT m1.sheet_id, m1.std_field, m1.std_pos, coalesce(p."column", m1."column") AS "column",
  CASE WHEN p."column" IS NOT NULL THEN 'proposal' WHEN m1."column" IS NOT NULL THEN 'rules' END AS stage
  FROM m1 FULL JOIN props p ON p.sheet_id = m1.sheet_id AND p.std_pos = m1.std_pos)"""


@query("merge_proposals", f"WITH {MERGED} SELECT {_M} FROM merged")
def _(spark, d):
    return mp.merge_proposals(sheet_proposals(spark, d), greedy(spark, d))


# -------------------------------------------------------------------- conflicts


@query("mapping_conflicts", f"""WITH {FILLED_KEY} SELECT sheet_id, "column", count(*) AS claims,
  string_agg(std_field, ',' ORDER BY std_pos) AS std_fields FROM m3 WHERE "column" IS NOT NULL
GROUP BY sheet_id, "column" HAVING count(*) > 1""")
def _(spark, d):
    return mp.mapping_conflicts(filled(spark, d)).withColumn(
        "std_fields", F.array_join("std_fields", ","))


_PRI = "CASE std_field " + " ".join(
    f"WHEN '{f.name}' THEN {f.priority}" for f in FIELDS if f.priority is not None) + " ELSE 999 END"


def resolved_sql(name: str, source: str) -> str:
    return (f"{name} AS MATERIALIZED (SELECT sheet_id, std_field, std_pos, CASE WHEN r = 1 THEN \"column\" END AS \"column\" "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, coalesce(\"column\", '#' || std_field) "
            f"ORDER BY {_PRI} DESC, std_pos) AS r FROM {source}) x)")


RESOLVED = FILLED_KEY + ",\n" + resolved_sql("final", "m3")
_R = 'sheet_id, std_field, std_pos, "column"'


@query("resolve_conflicts", f"WITH {RESOLVED} SELECT {_R} FROM final")
def _(spark, d):
    return resolved(spark, d).select("sheet_id", "std_field", "std_pos", "column")


def resolved(spark, d):
    return mp.resolve_conflicts(filled(spark, d), ENGLISH)


# -------------------------------------------------------------------- judgement

_NOTE = [f.name for f in FIELDS if f.required_note]
ISSUES = f"""issues AS (
SELECT sheet_id, 'missing_important' AS code, string_agg(std_field, ', ' ORDER BY std_pos) AS detail FROM final
  WHERE "column" IS NULL AND std_field IN ({in_list(_NOTE)}) GROUP BY sheet_id
UNION ALL SELECT sheet_id, 'route_without_waybill', '{ENGLISH.route_field}' FROM final GROUP BY sheet_id
  HAVING count("column") FILTER (WHERE std_field = '{ENGLISH.route_field}') > 0
  AND count("column") FILTER (WHERE std_field = '{ENGLISH.waybill_field}') = 0
UNION ALL SELECT sheet_id, 'no_quantity', '{', '.join(ENGLISH.quantity_fields)}' FROM final GROUP BY sheet_id
  HAVING count("column") FILTER (WHERE std_field IN ({in_list(ENGLISH.quantity_fields)})) = 0)"""
FINDING = "'{step}' AS step, '{severity}' AS severity"


@query("mapping_issues", f"""WITH {RESOLVED},\n{ISSUES} SELECT sheet_id, 'mapping' AS step, 'warning' AS severity,
  'mapping' AS subject, code, detail FROM issues""")
def _(spark, d):
    return mp.mapping_issues(resolved(spark, d), ENGLISH)


_IMPORTANT = in_list(f.name for f in FIELDS if f.important)
_OTHER = in_list(f.name for f in FIELDS if f.other)
_CONF = (f"(0.6e0 * (count(\"column\") FILTER (WHERE std_field IN ({_IMPORTANT})) / 6e0) "
         f"+ 0.3e0 * (count(\"column\") FILTER (WHERE std_field IN ({_OTHER})) / 6e0) + 0.1e0) * 100")
CONFIDENCE = (f"conf AS (SELECT sheet_id, count(*) AS total_fields, count(\"column\") AS mapped_fields, "
              f"CAST(count(\"column\") AS DOUBLE) / count(*) AS coverage, {srnd(_CONF, 1)} AS confidence "
              f"FROM final GROUP BY sheet_id)")


@query("mapping_confidence", f"WITH {RESOLVED},\n{CONFIDENCE} SELECT * FROM conf")
def _(spark, d):
    return mp.mapping_confidence(resolved(spark, d), ENGLISH)


@query("render_mapping", f"""WITH {RESOLVED},\n{ISSUES},\n{CONFIDENCE},
e AS (SELECT sheet_id, string_agg('"' || std_field || '":"' || coalesce("column", 'missing') || '"', ','
  ORDER BY std_pos) AS m FROM final GROUP BY sheet_id),
i AS (SELECT sheet_id, string_agg('"' || code || ': ' || detail || '"', ',' ORDER BY code, detail) AS r
  FROM issues GROUP BY sheet_id)
SELECT conf.sheet_id, '{{"mapping":{{' || e.m || '}},"analysis":{{"mapped_fields":' || mapped_fields
  || ',"reminders":[' || coalesce(i.r, '') || '],"accuracy":"' || CAST(confidence AS VARCHAR)
  || '%"}},"confidence":' || CAST(floor(confidence) AS BIGINT) || '}}' AS document
FROM conf JOIN e ON e.sheet_id = conf.sheet_id LEFT JOIN i ON i.sheet_id = conf.sheet_id""")
def _(spark, d):
    return mp.render_mapping(resolved(spark, d), ENGLISH)


DUPES = """SELECT sheet_id, 'mapping' AS step, 'error' AS severity, "column" AS subject,
  'duplicate_target' AS code, CAST(count(*) AS VARCHAR) AS detail FROM m3 WHERE "column" IS NOT NULL
GROUP BY sheet_id, "column" HAVING count(*) > 1"""
UNMAPPED = """SELECT sheet_id, 'mapping' AS step, 'warning' AS severity, std_field AS subject,
  'unmapped_field' AS code, 'missing' AS detail FROM m3 WHERE "column" IS NULL"""
SIMILAR = """similar_pairs AS (SELECT *, CASE WHEN contains(lower(std_field), lower("column"))
  OR contains(lower("column"), lower(std_field)) THEN 0.8e0
  ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END AS similarity
  FROM (SELECT *, list_distinct(string_split(lower(std_field), '')) AS a,
    list_distinct(string_split(lower("column"), '')) AS b FROM m3 WHERE "column" IS NOT NULL) x)"""
SUSPICIOUS = """SELECT sheet_id, 'mapping' AS step, 'warning' AS severity, std_field AS subject,
  'suspicious_mapping' AS code, "column" AS detail FROM similar_pairs WHERE similarity < {t}"""


@query("duplicate_targets", f"WITH {FILLED_KEY} {DUPES}")
def _(spark, d):
    return mp.duplicate_targets(filled(spark, d))


@query("unmapped_fields", f"WITH {FILLED_KEY} {UNMAPPED}")
def _(spark, d):
    return mp.unmapped_fields(filled(spark, d), ENGLISH)


@query("name_similarity", f"""WITH {FILLED_KEY},\n{SIMILAR} SELECT sheet_id, std_field, "column",
  {srnd('similarity', 6)} AS similarity FROM similar_pairs""")
def _(spark, d):
    return rnd(mp.name_similarity(filled(spark, d)), 6, "similarity").select(
        "sheet_id", "std_field", "column", "similarity")


@query("suspicious_mappings", f"WITH {FILLED_KEY},\n{SIMILAR} {SUSPICIOUS.format(t='0.3e0')}")
def _(spark, d):
    return mp.suspicious_mappings(filled(spark, d))


CHECKED = FILLED_KEY + ",\n" + SIMILAR + f""",
found AS ({DUPES} UNION ALL {UNMAPPED} UNION ALL {SUSPICIOUS.format(t='0.3e0')}),
checked AS (SELECT sheet_id, step, severity, 'mapping' AS subject, code,
  string_agg(DISTINCT subject, ', ' ORDER BY subject) AS detail FROM found GROUP BY sheet_id, step, severity, code)"""


@query("mapping_check", f"WITH {CHECKED} SELECT * FROM checked")
def _(spark, d):
    return mp.mapping_check(filled(spark, d), ENGLISH)


@query("mapping_score", f"""WITH {CHECKED}, s AS (SELECT m.sheet_id, count("column") AS mapped_fields,
  coalesce(any_value(e), 0) AS errors, coalesce(any_value(w), 0) AS warnings
  FROM m3 m LEFT JOIN (SELECT sheet_id, count(*) FILTER (WHERE severity = 'error') AS e,
    count(*) FILTER (WHERE severity = 'warning') AS w FROM checked GROUP BY sheet_id) k ON k.sheet_id = m.sheet_id
  GROUP BY m.sheet_id)
SELECT *, {srnd('greatest(0e0, least(100e0, (100e0 - errors * 30 - warnings * 10) * (mapped_fields / 15e0)))', 6)}
  AS mapping_quality_score FROM s""")
def _(spark, d):
    m = materialize(filled(spark, d))
    return rnd(mp.mapping_score(mp.mapping_check(m, ENGLISH), m, ENGLISH), 6, "mapping_quality_score")


@query("missing_summary", f"""WITH {RESOLVED} SELECT sheet_id, count(*) AS total_fields,
  count(*) - count("column") AS missing_count, count("column") = 0 AS all_missing,
  string_agg(CASE WHEN "column" IS NOT NULL THEN '✅ ' || std_field || ' ← ' || "column"
    ELSE '❌ ' || std_field || ' ← 未找到匹配' END, chr(10) ORDER BY std_pos) AS lines
FROM final GROUP BY sheet_id""")
def _(spark, d):
    return mp.missing_summary(resolved(spark, d))


# ---------------------------------------------------------------------- prompts

TEMPLATE = "Map these fields.\nData: {excel_data}\nAnswer in JSON."


@query("build_prompts", """WITH r AS (SELECT c_mktsegment AS sheet_id, c_custkey, row_number() OVER (
  PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name
  || '","c_nationkey":' || c_nationkey || '}' AS j FROM customer)
SELECT sheet_id, count(*) AS sample_rows, 'Map these fields.' || chr(10) || 'Data: [' ||
  string_agg(j, ', ' ORDER BY c_custkey) || ']' || chr(10) || 'Answer in JSON.' AS prompt
FROM r WHERE rn <= 100 GROUP BY sheet_id""")
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("seg"), "c_custkey", "c_name", "c_nationkey")
    return mp.build_prompts(c, "seg", "c_custkey", TEMPLATE)


# ---------------------------------------------------------------- whole pipeline

USABLE = CLASSIFIED.replace("profiles AS MATERIALIZED", "all_profiles AS MATERIALIZED", 1).replace(
    "classified AS MATERIALIZED",
    "profiles AS MATERIALIZED (SELECT * FROM all_profiles WHERE null_rate <= 0.9e0),\n"
    "classified AS MATERIALIZED", 1)
_rest = FILLED_KEY[len(CLASSIFIED):]
_named = SIMS[len(PROFILES):]
WHOLE = USABLE + _rest + _named + ",\n" + ",\n".join([
    "open3 AS (SELECT sheet_id, std_pos FROM m3 WHERE \"column\" IS NULL)",
    chain("v", "sims", ">= 0.4e0",
          "SELECT sheet_id, \"column\", std_pos, score FROM m3 WHERE \"column\" IS NOT NULL",
          "EXISTS (SELECT 1 FROM open3 o WHERE o.sheet_id = s.sheet_id AND o.std_pos = s.std_pos)"),
    f"m4 AS MATERIALIZED (SELECT m3.sheet_id, m3.std_field, m3.std_pos, v.\"column\" FROM m3 "
    f"LEFT JOIN v{N} v ON v.sheet_id = m3.sheet_id AND v.std_pos = m3.std_pos)",
    resolved_sql("final", "m4"),
])


@query("map_fields", f"WITH {WHOLE} SELECT {_R} FROM final")
def _(spark, d):
    return onboarding.map_fields(profiles(spark, d), ENGLISH).select(
        "sheet_id", "std_field", "std_pos", "column")


#: a reply for each sheet: one that proposes its first column, one without entries but with a line, none
def sheet_replies(found):
    kind = F.length("sheet_id") % 3
    first = found.groupBy("sheet_id").agg(F.min_by("column", "position").alias("c"))
    return first.select("sheet_id", F.when(kind == 0, F.concat(F.lit('ok {"mapping": {"order_key": "'), F.col("c"),
                                                              F.lit('", "vehicle": "missing"}}')))
                        .when(kind == 1, F.concat(F.lit('{"mapping": {}}\ncarrier: '), F.col("c"))).alias("text"))


_replied = _rest[:_rest.index("m3 AS MATERIALIZED")] + """first AS (SELECT sheet_id, arg_min("column", position) AS c FROM all_profiles GROUP BY sheet_id),
m3 AS MATERIALIZED (SELECT m.sheet_id, m.std_field, m.std_pos, length(m.sheet_id) % 3 AS kind, m.score, CASE length(m.sheet_id) % 3
  WHEN 0 THEN CASE WHEN m.std_field = 'order_key' THEN c END
  WHEN 1 THEN CASE WHEN m.std_field = 'carrier' THEN c ELSE m."column" END
  ELSE coalesce(m."column", h.first_col) END AS "column"
  FROM m1 m JOIN first f ON f.sheet_id = m.sheet_id LEFT JOIN hits h ON h.sheet_id = m.sheet_id AND h.std_pos = m.std_pos)"""
REPLIED = (USABLE + _replied + WHOLE[len(USABLE + _rest):]).replace(
    "open3 AS (SELECT sheet_id, std_pos FROM m3 WHERE \"column\" IS NULL)",
    "open3 AS (SELECT sheet_id, std_pos FROM m3 WHERE \"column\" IS NULL AND kind <> 1)")


@query("map_fields_replies", f"WITH {REPLIED} SELECT {_R} FROM final")
def _(spark, d):
    found = materialize(profiles(spark, d))
    return onboarding.map_fields(found, ENGLISH, sheet_replies(found)).select(
        "sheet_id", "std_field", "std_pos", "column")


@query("map_fields_confidence", f"WITH {WHOLE},\n{CONFIDENCE} SELECT * FROM conf")
def _(spark, d):
    return mp.mapping_confidence(onboarding.map_fields(profiles(spark, d), ENGLISH), ENGLISH)

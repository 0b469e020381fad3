"""Sources, sinks, row caps, cells and header repair."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks.inputs import (
    CELLS,
    ORDER_COLS,
    ORDERS,
    kind_sql,
    order_cells,
    order_sheets,
    profiles,
    table,
)
from sheetloom.functions.exprs import text_kind
from sheetloom.operators import reshape as rs
from sheetloom.operators.profiling import profile_cells
from sheetloom.plans.onboarding import repair_headers
from sheetloom.plans.lineage import shared_folder
from sheetloom.sources import cells as cl
from sheetloom.sources import sheets as src

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def scratch(spark, name: str) -> str:
    """A new folder next to the tables the cluster shares."""
    return os.path.join(shared_folder(spark), f"{name}-{os.urandom(6).hex()}")


# ----------------------------------------------------------------- sources


@query("read_sheets", """SELECT 'orders.parquet' AS sheet_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""")
def _(spark, d):
    return src.read_sheets(spark, f"{d}/orders.parquet", "parquet").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


#: two folders of files with the same name, columns in another order, and one that lacks a column
def csv_folder(spark, d: str) -> str:
    root = scratch(spark, "csv")
    c = table(spark, d, "customer")
    money = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("a, "), F.lit('"'), F.col("c_name"), F.lit('"')))
    note = money.alias("note, of")
    for name, part in (("east 1+2%/订单", c.where("c_nationkey < 12").select("c_custkey", note, "c_mktsegment")),
                       ("west/订单", c.where("c_nationkey >= 12").select("c_mktsegment", "c_nationkey", "c_custkey"))):
        part.write.option("header", "true").option("escape", '"').csv(f"{root}/{name}")
    return root


CSV_SHEETS = """sheets AS (
  SELECT 'east 1+2%/订单' AS folder, c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'a, "' || c_name || '"' END AS note,
         c_mktsegment, NULL AS c_nationkey FROM customer WHERE c_nationkey < 12
  UNION ALL SELECT 'west/订单', c_custkey, NULL, c_mktsegment, c_nationkey FROM customer WHERE c_nationkey >= 12)"""


def folder(c: str = "sheet_id"):
    return F.regexp_replace(c, "/[^/]*$", "")


@query("read_sheets_csv", f"""WITH {CSV_SHEETS} SELECT folder, c_custkey, note, c_mktsegment, c_nationkey FROM sheets""")
def _(spark, d):
    schema = "c_custkey bigint, `note, of` string, c_mktsegment string, c_nationkey int"
    return src.read_sheets(spark, csv_folder(spark, d), "csv", schema).select(
        folder().alias("folder"), "c_custkey", F.col("`note, of`").alias("note"), "c_mktsegment", "c_nationkey")


@query("read_cells", f"""WITH {CSV_SHEETS}, cells AS (
  SELECT folder, 0 AS col_no, 'c_custkey' AS "column", CAST(c_custkey AS VARCHAR) AS raw, 'int' AS kind FROM sheets
    WHERE folder LIKE 'east%'
  UNION ALL SELECT folder, 1, 'note, of', note, CASE WHEN note IS NULL THEN 'null' ELSE 'text' END FROM sheets
    WHERE folder LIKE 'east%'
  UNION ALL SELECT folder, 2, 'c_mktsegment', c_mktsegment, 'text' FROM sheets WHERE folder LIKE 'east%'
  UNION ALL SELECT folder, 0, 'c_mktsegment', c_mktsegment, 'text' FROM sheets WHERE folder LIKE 'west%'
  UNION ALL SELECT folder, 1, 'c_nationkey', CAST(c_nationkey AS VARCHAR), 'int' FROM sheets WHERE folder LIKE 'west%'
  UNION ALL SELECT folder, 2, 'c_custkey', CAST(c_custkey AS VARCHAR), 'int' FROM sheets WHERE folder LIKE 'west%')
SELECT folder, col_no, "column", raw, kind, count(*) AS n FROM cells GROUP BY ALL""")
def _(spark, d):
    found = cl.read_cells(spark, csv_folder(spark, d), pathGlobFilter="*.csv")
    return found.groupBy(folder().alias("folder"), "col_no", "column", "raw", "kind").agg(F.count("row_no").alias("n"))


#: records whose keys differ: two kinds of events leave out one each
@query("read_cells_json", """WITH r AS (
  SELECT event_type, event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
         CASE WHEN event_type <> 'click' THEN event_type || ' "x", ' || user_id END AS note FROM events)
SELECT event_type, c AS "column", raw, kind, count(*) AS n FROM (
  SELECT event_type, 'event_id' AS c, CAST(event_id AS VARCHAR) AS raw, 'int' AS kind FROM r
  UNION ALL SELECT event_type, 'user_id', CAST(user_id AS VARCHAR), 'int' FROM r WHERE event_type <> 'error'
  UNION ALL SELECT event_type, 'note', note, 'text' FROM r WHERE event_type <> 'click') x GROUP BY ALL""")
def _(spark, d):
    e = table(spark, d, "events")
    note = F.concat(F.col("event_type"), F.lit(' "x", '), F.col("user_id").cast("string"))
    path = scratch(spark, "records") + "/events"
    src.write_json(e.select("event_type", "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
                            F.when(F.col("event_type") != "click", note).alias("note")), path, "event_type")
    found = cl.read_cells(spark, path, "json", pathGlobFilter="*.json")
    return found.groupBy(F.regexp_extract("sheet_id", "event_type=([^/]*)", 1).alias("event_type"), "column", "raw",
                         "kind").agg(F.count("row_no").alias("n"))


@query("read_sheets_json", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    path = scratch(spark, "json") + "/customer"
    src.write_json(table(spark, d, "customer"), path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return src.read_sheets(spark, path, "json", schema).drop("sheet_id")


#: columnar payloads: one row of lists per vector, the second list is shorter
@query("columnar_to_rows", """SELECT vec_id, CAST(i - 1 AS INT) AS row_no, CAST(embedding[i] AS DOUBLE) AS embedding,
  CASE WHEN i <= 10 THEN CAST(embedding[i] AS DOUBLE) END AS head FROM (
  SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) x""")
def _(spark, d):
    lists = table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
        F.slice("embedding", 1, 10).cast("array<double>").alias("head"), F.lit("no list").alias("note"))
    return src.columnar_to_rows(lists, keep=["vec_id"])


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


@query("file_inventory", "WITH n AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES) + """)
SELECT t || '.parquet' AS file_name, t || '.parquet' AS sheet_id, n AS row_count, CAST(count(*) AS INT) AS column_count,
       string_agg(column_name, ',' ORDER BY ordinal_position) AS columns
FROM n JOIN information_schema.columns c ON c.table_name = t GROUP BY t, n""")
def _(spark, d):
    return src.file_inventory(spark, d, "*.parquet").select(
        "file_name", "sheet_id", "row_count", "column_count", F.array_join("columns", ",").alias("columns"))


@query("file_inventory_csv", f"""WITH {CSV_SHEETS} SELECT folder, CAST(count(*) AS BIGINT) AS row_count,
  CASE WHEN folder LIKE 'east%' THEN 'c_custkey|note, of|c_mktsegment' ELSE 'c_mktsegment|c_nationkey|c_custkey' END
  AS columns FROM sheets GROUP BY folder""")
def _(spark, d):
    found = src.file_inventory(spark, csv_folder(spark, d), "*.csv", "csv")
    return found.groupBy(folder().alias("folder"), F.array_join("columns", "|").alias("columns")).agg(
        F.sum("row_count").alias("row_count"))


#: payloads with unlike columns: a list per kind of event, keys that differ by user, an entry that is no list
@query("payload_cells", """WITH u AS (SELECT user_id, event_type, event_id, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i FROM events),
cols AS (SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS col_no,
    count(*) AS n FROM events GROUP BY user_id, event_type),
size AS (SELECT user_id, max(n) AS rows FROM cols GROUP BY user_id)
SELECT CAST(c.user_id AS VARCHAR) AS sheet_id, r.i AS row_no, CAST(c.col_no AS INT) AS col_no, c.event_type AS "column",
  CAST(u.event_id AS VARCHAR) AS raw, CASE WHEN u.event_id IS NULL THEN 'null' ELSE 'int' END AS kind
FROM cols c JOIN size s USING (user_id) JOIN range(0, 100000) r(i) ON r.i < s.rows
LEFT JOIN u ON u.user_id = c.user_id AND u.event_type = c.event_type AND u.i = r.i""")
def _(spark, d):
    lists = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    entry = F.concat(F.lit('"'), F.col("event_type"), F.lit('": '), F.to_json("ids"))
    payloads = lists.groupBy(F.col("user_id").cast("string").alias("sheet_id")).agg(F.concat(
        F.lit('{"note": "none", '), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("}")).alias("payload"))
    return cl.payload_cells(payloads)


@query("union_sheets", """SELECT 'customers' AS sheet, c_acctbal AS acctbal, c_name AS name, c_mktsegment AS segment
  FROM customer UNION ALL SELECT 'suppliers', s_acctbal, s_name, NULL FROM supplier""")
def _(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"))
    s = table(spark, d, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return src.union_sheets({"customers": c, "suppliers": s})


@query("cap_rows", """SELECT sheet_id, o_orderkey, o_custkey FROM (SELECT o_orderstatus AS sheet_id, o_orderkey,
  o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) x WHERE rn <= 100""")
def _(spark, d):
    return rs.cap_rows(order_sheets(spark, d), "sheet_id", "o_orderkey").select(
        "sheet_id", "o_orderkey", "o_custkey")


@query("sheet_meta", """WITH s AS (SELECT source AS sheet_id, count(*) AS n FROM documents GROUP BY source)
SELECT sheet_id, n AS original_rows, least(n, 100) AS data_rows, n > 100 AS truncated FROM s
UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(least(n, 100)) AS BIGINT), bool_or(n > 100) FROM s""")
def _(spark, d):
    return rs.sheet_meta(table(spark, d, "documents"), "source")


@query("cap_frame", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return rs.cap_frame(table(spark, d, "orders"), "o_orderkey", 100, 3)


@query("frame_shape", """SELECT count(*) AS original_rows, 6 AS original_cols, least(count(*), 100) AS kept_rows,
  3 AS kept_cols, TRUE AS truncated FROM orders""")
def _(spark, d):
    return rs.frame_shape(table(spark, d, "orders"), 100, 3)


@query("write_json", "SELECT o_orderstatus, o_orderkey, o_orderpriority FROM orders")
def _(spark, d):
    path = scratch(spark, "out") + "/orders"
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority")
    src.write_json(o, path, "o_orderstatus")
    schema = "o_orderkey bigint, o_orderpriority string, o_orderstatus string"
    return spark.read.schema(schema).json(path)


@query("append_history", """SELECT o_orderstatus AS sheet_id, o_orderpriority AS subject, count(*) AS n, 'second' AS run_id
  FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def _(spark, d):
    path = scratch(spark, "history") + "/runs"
    found = table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("sheet_id"), F.col("o_orderpriority").alias("subject")
    ).agg(F.count(F.lit(1)).alias("n"))
    for run in ("first", "second", "second"):
        src.append_history(found, path, run)
    return src.latest_history(src.read_history(spark, path)).drop("validated_at")


@query("compact_history", """SELECT o_orderstatus AS sheet_id, o_orderpriority AS subject, count(*) AS n,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'run 2' ELSE 'run 0' END AS run_id
  FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def _(spark, d):
    path = scratch(spark, "history") + "/runs"
    found = table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("sheet_id"), F.col("o_orderpriority").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    urgent = F.col("subject") == "1-URGENT"
    src.append_history(found, path, "run 0")
    src.append_history(found, path, "run 1")
    src.compact_history(spark, path)
    # batches that are played again after they were compacted
    src.append_history(found.where(~urgent), path, "run 0")
    src.append_history(found.where("false"), path, "run 1")
    src.compact_history(spark, path)
    src.append_history(found.where(urgent), path, "run 2")
    return src.read_history(spark, path).drop("validated_at")


# ------------------------------------------------------------------- cells


@query("to_cells", f"""WITH {CELLS} SELECT sheet_id, row_no, col_no, "column",
  CASE WHEN "column" = 'o_totalprice' THEN NULL ELSE raw END AS raw, kind FROM cells""")
def _(spark, d):
    return order_cells(spark, d).withColumn(
        "raw", F.when(F.col("column") != "o_totalprice", F.col("raw")))


@query("from_cells", f"""WITH {ORDERS} SELECT sheet_id, o_orderkey AS row_no, CAST(o_custkey AS VARCHAR) AS o_custkey,
  o_orderdate, o_orderpriority, o_ref FROM ords""")
def _(spark, d):
    return rs.from_cells(order_cells(spark, d), ORDER_COLS).drop("o_totalprice")


@query("from_cells_map", f"""WITH {ORDERS} SELECT sheet_id, o_orderkey AS row_no, 5 AS n_keys, o_orderdate, o_ref FROM ords""")
def _(spark, d):
    rows = rs.from_cells(order_cells(spark, d))
    return rows.select("sheet_id", "row_no", F.size("row").alias("n_keys"),
                       F.element_at("row", "o_orderdate").alias("o_orderdate"),
                       F.element_at("row", "o_ref").alias("o_ref"))


@query("infer_cell_kind", """SELECT doc_id AS row_no, raw, """ + kind_sql("raw") + """ AS kind FROM (
  SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN CAST(n_chars AS VARCHAR)
    WHEN 'de' THEN CAST(n_chars AS VARCHAR) || '.25' ELSE CASE WHEN n_chars > 500 THEN 'True' END END AS raw
  FROM documents)""")
def _(spark, d):
    n = F.col("n_chars").cast("string")
    cells = table(spark, d, "documents").select(
        F.col("doc_id").alias("row_no"),
        F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", n)
        .when(F.col("lang") == "de", F.concat(n, F.lit(".25")))
        .when(F.col("n_chars") > 500, "True").alias("raw"))
    return rs.infer_cell_kind(cells)


@query("normalize_values", """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
  CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END AS seen, event_type FROM events""")
def _(spark, d):
    ev = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        (F.col("event_type") == "view").alias("seen"), "event_type")
    return rs.normalize_values(ev)


# ----------------------------------------------------------------- headers

#: one "sheet" per document: its first words are headers, some blank or unnamed
def headers(spark, d):
    words = F.split(F.regexp_replace("text", r"[^a-zA-Z ]", " "), " ")
    return table(spark, d, "documents").select(
        F.col("source").alias("sheet_id"), F.col("doc_id").alias("col_no"),
        F.when(F.col("lang") == "en", F.concat(F.lit("Unnamed: "), F.col("doc_id").cast("string")))
        .when(F.col("lang") == "fr", F.lit("  "))
        .when(F.col("lang") == "de", F.lit(" weight "))
        .otherwise(F.element_at(words, 1)).alias("header"))


HEADERS = """headers AS (SELECT source AS sheet_id, doc_id AS col_no, CASE lang WHEN 'en' THEN 'Unnamed: ' || doc_id
  WHEN 'fr' THEN '  ' WHEN 'de' THEN ' weight '
  ELSE string_split(regexp_replace(text, '[^a-zA-Z ]', ' ', 'g'), ' ')[1] END AS header FROM documents)"""


@query("unnamed_ratio", f"""WITH {HEADERS}, f AS (SELECT sheet_id, CASE WHEN header IS NULL OR trim(header) = ''
  OR lower(header) LIKE 'unnamed%' THEN 1e0 ELSE 0e0 END AS u FROM headers)
SELECT sheet_id, count(*) AS headers, sum(u) / count(*) AS unnamed_ratio, sum(u) / count(*) >= 0.6e0 AS repair
FROM f GROUP BY sheet_id""")
def _(spark, d):
    return rs.unnamed_ratio(headers(spark, d))


_DEDUPE = """named AS (SELECT *, CASE WHEN header IS NULL OR trim(header) = '' THEN '列' ELSE trim(header) END AS base
  FROM headers),
first_pass AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, base ORDER BY col_no) - 1 AS k FROM named),
second_pass AS (SELECT *, CASE WHEN k > 0 THEN base || '_' || k ELSE base END AS c1 FROM first_pass),
third_pass AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, c1 ORDER BY col_no) - 1 AS k2 FROM second_pass)
SELECT sheet_id, col_no, header, CASE WHEN k2 > 0 THEN c1 || '_' || k2 ELSE c1 END AS "column" FROM third_pass"""


@query("dedupe_headers", f"WITH {HEADERS}, {_DEDUPE}")
def _(spark, d):
    return rs.dedupe_headers(headers(spark, d))


#: raw sheets without headers: a title row, a header row, then orders of one customer
def raw_cells(spark, d):
    o = table(spark, d, "orders").select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("sheet_id"),
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    from pyspark.sql import Window as W
    rn = F.row_number().over(W.partitionBy("sheet_id").orderBy("o_orderkey"))
    body = o.withColumn("row_no", (rn + 1).cast("long"))
    text = lambda c: F.col(c).cast("string")
    rows = body.select("sheet_id", "row_no", F.array(
        text("o_orderkey"), text("o_orderstatus"), text("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "F", "x")).alias("v"))
    ids = o.select("sheet_id").distinct()
    none = F.lit(None).cast("string")
    title = ids.select("sheet_id", F.lit(0).cast("long").alias("row_no"),
                       F.array(F.lit("Report"), none, none, none).alias("v"))
    head = ids.select("sheet_id", F.lit(1).cast("long").alias("row_no"),
                      F.array(F.lit("order no"), F.lit("status"), F.lit("priority"), F.lit("status")).alias("v"))
    cells = rows.unionByName(title).unionByName(head).select(
        "sheet_id", "row_no", F.posexplode("v").alias("col_no", "raw"))
    return cells.select(
        "sheet_id", "row_no", "col_no",
        F.concat(F.lit("Unnamed: "), F.col("col_no").cast("string")).alias("column"),
        "raw", text_kind(F.col("raw")).alias("kind"))


RAW = """o AS (SELECT 'cust' || o_custkey AS sheet_id, *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1
    AS row_no FROM orders),
rawc AS (SELECT sheet_id, row_no, 0 AS col_no, CAST(o_orderkey AS VARCHAR) AS raw FROM o
  UNION ALL SELECT sheet_id, row_no, 1, o_orderstatus FROM o UNION ALL SELECT sheet_id, row_no, 2, o_orderpriority FROM o
  UNION ALL SELECT sheet_id, row_no, 3, CASE WHEN o_orderstatus = 'F' THEN 'x' END FROM o
  UNION ALL SELECT i.sheet_id, t.r, t.c, t.v FROM (SELECT DISTINCT sheet_id FROM o) i CROSS JOIN (VALUES
    (0, 0, 'Report'), (0, 1, NULL), (0, 2, NULL), (0, 3, NULL), (1, 0, 'order no'), (1, 1, 'status'),
    (1, 2, 'priority'), (1, 3, 'status')) t(r, c, v)),
cells AS MATERIALIZED (SELECT *, 'Unnamed: ' || col_no AS "column", """ + kind_sql("raw") + """ AS kind FROM rawc)"""
DETECT = """scored AS (SELECT sheet_id, row_no, count(*) FILTER (WHERE kind = 'text' AND trim(raw) <> '') AS score
  FROM cells WHERE row_no < 10 GROUP BY sheet_id, row_no),
best AS (SELECT sheet_id, row_no AS header_row, score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id
  ORDER BY score DESC, row_no) AS rn FROM scored) x WHERE rn = 1 AND score > 0)"""


@query("detect_header_row", f"WITH {RAW}, {DETECT} SELECT * FROM best")
def _(spark, d):
    return rs.detect_header_row(raw_cells(spark, d))


#: 'status' repeats, so the fourth header becomes status_1
PROMOTE = f"""WITH {RAW}, {DETECT},
headers AS (SELECT c.sheet_id, c.col_no, CASE WHEN lower(c.raw) LIKE 'unnamed%' THEN NULL ELSE c.raw END AS header
  FROM cells c JOIN best b ON b.sheet_id = c.sheet_id AND b.header_row = c.row_no),
names AS (WITH {_DEDUPE})
SELECT c.sheet_id, c.row_no - b.header_row - 1 AS row_no, c.col_no, n."column", c.raw, c.kind
FROM cells c JOIN best b ON b.sheet_id = c.sheet_id AND c.row_no > b.header_row
JOIN names n ON n.sheet_id = c.sheet_id AND n.col_no = c.col_no"""


@query("promote_header", PROMOTE)
def _(spark, d):
    cells = raw_cells(spark, d)
    return rs.promote_header(cells, rs.detect_header_row(cells))


#: by number of the customer: a header row to promote, headers that need cleaning, sheets without any text
def mixed_cells(spark, d):
    kind = F.substring("sheet_id", 5, 20).cast("int") % 3
    given = F.get(F.array(F.lit(" order "), F.lit("qty"), F.lit("qty"), F.lit(None).cast("string")), F.col("col_no"))
    raw = F.when((kind != 2) | (F.col("kind") == "int"), F.col("raw"))
    return raw_cells(spark, d).withColumn("column", F.when(kind == 1, given).otherwise(F.col("column"))) \
        .withColumn("raw", raw).withColumn("kind", text_kind(F.col("raw")))


MIXED = f"""{RAW}, mixed AS MATERIALIZED (SELECT sheet_id, row_no, col_no, CASE WHEN k <> 1 THEN "column"
    WHEN col_no = 0 THEN ' order ' WHEN col_no < 3 THEN 'qty' END AS "column",
    CASE WHEN k <> 2 OR kind = 'int' THEN raw END AS raw, CASE WHEN k <> 2 OR kind = 'int' THEN kind ELSE 'null' END AS kind, k
  FROM (SELECT *, CAST(substr(sheet_id, 5) AS INT) % 3 AS k FROM cells) x),
{DETECT.replace("FROM cells WHERE", "FROM mixed WHERE k <> 1 AND")},
headers AS (SELECT c.sheet_id, c.col_no, CASE WHEN lower(c.raw) LIKE 'unnamed%' THEN NULL ELSE c.raw END AS header
  FROM mixed c JOIN best b ON b.sheet_id = c.sheet_id AND b.header_row = c.row_no
  UNION ALL SELECT DISTINCT sheet_id, col_no, "column" FROM mixed WHERE sheet_id NOT IN (SELECT sheet_id FROM best)),
names AS (WITH {_DEDUPE}),
repaired AS (SELECT c.sheet_id, coalesce(c.row_no - b.header_row - 1, c.row_no) AS row_no, c.col_no, n."column", c.raw, c.kind
  FROM mixed c LEFT JOIN best b ON b.sheet_id = c.sheet_id JOIN names n ON n.sheet_id = c.sheet_id AND n.col_no = c.col_no
  WHERE b.header_row IS NULL OR c.row_no > b.header_row)"""


@query("repair_headers", f"WITH {MIXED} SELECT * FROM repaired")
def _(spark, d):
    return repair_headers(mixed_cells(spark, d))


#: headers as they are: repeated, and blank in the last column
@query("from_cells_repeated", f"""WITH {MIXED}, c AS (SELECT sheet_id, row_no, max(raw) FILTER (WHERE col_no = 1) AS a,
  max(raw) FILTER (WHERE col_no = 2) AS b, max(raw) FILTER (WHERE col_no = 3) AS c FROM mixed WHERE k = 1 GROUP BY 1, 2)
SELECT sheet_id, row_no, a AS qty, b AS qty_1, c AS blank FROM c""")
def _(spark, d):
    cells = mixed_cells(spark, d).where(F.substring("sheet_id", 5, 20).cast("int") % 3 == 1)
    get = lambda k: F.element_at("row", k)
    return rs.from_cells(cells).select("sheet_id", "row_no", get("qty").alias("qty"), get("qty_1").alias("qty_1"),
                                       get("列").alias("blank"))


# ------------------------------------------------------------- column filters

#: per-sheet profiles in which sparse columns exist
def sparse_profiles(spark, d):
    return profile_cells(rs.promote_header(raw_cells(spark, d), rs.detect_header_row(raw_cells(spark, d))))


_SPARSE = PROMOTE.replace("SELECT c.sheet_id, c.row_no - b.header_row - 1 AS row_no, c.col_no, n.\"column\", c.raw, c.kind\nFROM",
                          ", body AS (SELECT c.sheet_id, c.col_no, n.\"column\", c.raw FROM") + """),
prof AS (SELECT sheet_id, "column", count(*) AS total_rows, count(*) FILTER (WHERE raw <> '') AS non_null,
  CAST(count(*) - count(*) FILTER (WHERE raw <> '') AS DOUBLE) / count(*) AS null_rate FROM body
  GROUP BY sheet_id, "column")
SELECT sheet_id, "column", total_rows, non_null, null_rate FROM prof WHERE """
_PC = ["sheet_id", "column", "total_rows", "non_null", "null_rate"]


@query("drop_sparse", _SPARSE + "null_rate <= 0.9e0")
def _(spark, d):
    return rs.drop_sparse(sparse_profiles(spark, d)).select(*_PC)


@query("drop_sparse_protected", _SPARSE + "null_rate <= 0.9e0 OR contains(\"column\", 'status')")
def _(spark, d):
    return rs.drop_sparse(sparse_profiles(spark, d), 0.9, ["status"]).select(*_PC)


@query("drop_all_null", _SPARSE + "non_null > 0")
def _(spark, d):
    return rs.drop_all_null(sparse_profiles(spark, d)).select(*_PC)


_CONST = {"a": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 1 END", "b": "CASE WHEN l_tax >= 0 THEN 0e0 END",
          "c": "l_quantity", "t": "l_linestatus"}


@query("drop_constant", "WITH x AS (SELECT l_returnflag AS sheet_id, 1 AS a, l_quantity * 0e0 AS b, l_quantity AS c, "
       "l_linestatus AS t, CASE WHEN l_returnflag = 'A' THEN '1' ELSE l_linestatus END AS u FROM lineitem)\n"
       + "\nUNION ALL ".join(
           f"SELECT sheet_id, '{c}' AS \"column\", {i} AS position FROM x GROUP BY sheet_id HAVING NOT "
           f"(min(CAST({c} AS VARCHAR)) = max(CAST({c} AS VARCHAR)) AND min(CAST({c} AS VARCHAR)) IN ('0', '1', '0.0'))"
           for i, c in enumerate(["a", "b", "c", "t", "u"])))
def _(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("sheet_id"), F.lit(1).alias("a"),
        (F.col("l_quantity") * 0.0).alias("b"), F.col("l_quantity").alias("c"),
        F.col("l_linestatus").alias("t"),
        F.when(F.col("l_returnflag") == "A", "1").otherwise(F.col("l_linestatus")).alias("u"))
    return rs.drop_constant(x, "sheet_id")

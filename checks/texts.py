"""Messages, replies, chunks, run log, and their streaming forms."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from checks.inputs import srnd, table
from checks.shape import scratch
from sheetloom.operators import conversation as cv
from sheetloom.operators import runlog as rl
from sheetloom.operators import validation as va
from sheetloom.sources import sheets as src
from sheetloom.streaming import live

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ---------------------------------------------------------------- conversations


@query("assemble_messages", """SELECT conv_id, CAST(0 AS BIGINT) AS part, count(*) AS message_count,
  string_agg(turn || ':' || role || ':' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id""")
def _(spark, d):
    m = cv.assemble_messages(table(spark, d, "conversations"), "conv_id", "turn")
    return m.withColumn("messages", F.array_join(F.transform(
        "messages", lambda x: F.concat_ws(":", x.turn.cast("string"), x.role, x.text)), "|"))


@query("assemble_messages_parts", """SELECT conv_id, turn // 3 AS part, count(*) AS message_count,
  string_agg(turn || ':' || role, '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id, turn // 3""")
def _(spark, d):
    m = cv.assemble_messages(table(spark, d, "conversations"), "conv_id", "turn", ("role",), 3)
    return m.withColumn("messages", F.array_join(F.transform(
        "messages", lambda x: F.concat_ws(":", x.turn.cast("string"), x.role)), "|"))


@query("last_message", """SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM conversations
  GROUP BY conv_id""")
def _(spark, d):
    return cv.last_message(table(spark, d, "conversations"), "conv_id", "turn")


@query("render_template", """SELECT conv_id, turn, 'You are ' || role || '. Data: ' || text || '!' AS system_message,
  'Turn ' || turn || ' of ' || conv_id AS user_message FROM conversations""")
def _(spark, d):
    return cv.render_template(
        table(spark, d, "conversations"), "You are {role}. Data: {text}!", "Turn {turn} of {conv_id}",
        ["role", "text", "turn", "conv_id"], ["conv_id", "turn"])


#: whole documents dressed with blank lines, fences and reasoning tags
def dressed(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat(t, F.lit("\n\n\nNext. Code:\n```  x. y  ```end\n\n"), t))
        .when(F.col("lang") == "fr", F.concat(F.lit("<think>"), t, F.lit("</think> So. Done ")))
        .otherwise(F.concat(F.lit("  "), t, F.lit("\n\n - a. b\n"))).alias("text"))


DRESSED = """dressed AS (SELECT doc_id, CASE lang WHEN 'en' THEN text || chr(10) || chr(10) || chr(10) || 'Next. Code:'
  || chr(10) || '```  x. y  ```end' || chr(10) || chr(10) || text WHEN 'fr' THEN '<think>' || text || '</think> So. Done '
  ELSE '  ' || text || chr(10) || chr(10) || ' - a. b' || chr(10) END AS text FROM documents)"""
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("format_replies", f"""WITH {DRESSED}, p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n{{2,}}')) AS p,
  generate_subscripts(string_split_regex(text, '\\n{{2,}}'), 1) AS i FROM dressed),
f AS (SELECT doc_id, i, {_STRIP.format("CASE WHEN contains(p, '```') THEN array_to_string(list_transform(string_split(p, '```'), "
"lambda s, k: CASE WHEN k % 2 = 0 THEN chr(10) || '```' || chr(10) || " + _STRIP.format('s') + " || chr(10) || '```' || chr(10) ELSE s END), '') "
"ELSE replace(p, '. ', '.' || chr(10)) END")} AS p FROM p)
SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS formatted FROM f GROUP BY doc_id""")
def _(spark, d):
    return cv.format_replies(dressed(spark, d)).select("doc_id", "formatted")


@query("rewrite_think_tags", f"""WITH {DRESSED} SELECT doc_id, {_STRIP.format(
  "replace(replace(text, '<think>', '**思考过程**：' || chr(10)), '</think>', chr(10) || chr(10) || '**最终回复**：' || chr(10))")}
  AS rewritten FROM dressed""")
def _(spark, d):
    return cv.rewrite_think_tags(dressed(spark, d)).select("doc_id", "rewritten")


#: whole documents whose lines become advice lines by language
def advice(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.regexp_replace(t, r"\n", "\n1. "))
        .when(F.col("lang") == "fr", F.concat(F.lit("  - "), t, F.lit("\n9. no\n--  \n3.x")))
        .otherwise(t).alias("text"))


@query("parse_recommendations", f"""WITH a AS (SELECT doc_id, CASE lang WHEN 'en' THEN replace(text, chr(10), chr(10) || '1. ')
  WHEN 'fr' THEN '  - ' || text || chr(10) || '9. no' || chr(10) || '--  ' || chr(10) || '3.x' ELSE text END AS text FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)),
  lambda s: {_STRIP.format('s')}), lambda s: regexp_matches(s, '^([1-5]\\.|-)')),
  lambda s: {_STRIP.format("regexp_replace(s, '^[0-9.\\- ]+', '')")}), lambda s: s <> '') AS r FROM a),
r AS (SELECT doc_id, CASE WHEN len(r) > 0 THEN r ELSE ['请根据验证结果手动检查数据质量'] END AS r FROM l)
SELECT doc_id, CAST(generate_subscripts(r, 1) - 1 AS INT) AS line_no, unnest(r) AS recommendation FROM r""")
def _(spark, d):
    return cv.parse_recommendations(advice(spark, d), keep=["doc_id"])


# ---------------------------------------------------------------------- chunks

#: events as server-sent lines; signups are broken lines, errors stop a reply
def sse(spark, d):
    t = F.col("event_type")
    line = F.concat(
        F.lit('data: {"code": 200, "data": {"id": "'), F.col("user_id").cast("string"),
        F.lit('", "content": "'), F.when(t == "error", "").otherwise(F.concat(t, F.lit(" "))),
        F.lit('", "finishReason": "'), F.when(t == "error", "stop").otherwise("null"), F.lit('"}}'))
    return table(spark, d, "events").select(
        "event_id", F.col("ts"),
        F.when(t == "signup", F.concat(F.lit("data: oops "), line)).otherwise(line).alias("line"))


SSE = """chunks AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type = 'error' THEN ''
  ELSE event_type || ' ' END AS content, CASE WHEN event_type = 'error' THEN 'stop' ELSE 'null' END AS finish_reason
  FROM events WHERE event_type <> 'signup')"""


@query("decode_events", f"WITH {SSE} SELECT * FROM chunks")
def _(spark, d):
    return cv.decode_events(sse(spark, d), keep=["event_id"])


_REASM = """, placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) - 1 AS pos FROM chunks),
s AS (SELECT id, min(event_id) FILTER (WHERE finish_reason = 'stop') AS stop_at FROM chunks GROUP BY id)
SELECT c.id, {part} AS part, coalesce(string_agg(content, '' ORDER BY event_id) FILTER (WHERE finish_reason <> 'stop'), '')
  AS content, count(*) FILTER (WHERE finish_reason <> 'stop') AS chunks, bool_or(stop_at IS NOT NULL) AS finished
FROM placed c JOIN s ON s.id = c.id WHERE stop_at IS NULL OR event_id <= stop_at GROUP BY c.id, {part}"""


@query("reassemble_chunks", f"WITH {SSE}" + _REASM.format(part="CAST(0 AS BIGINT)"))
def _(spark, d):
    chunks = cv.decode_events(sse(spark, d), keep=["event_id"])
    return cv.reassemble_chunks(chunks, "id", "event_id")


@query("reassemble_chunks_parts", f"WITH {SSE}" + _REASM.format(part="pos // 5"))
def _(spark, d):
    chunks = cv.decode_events(sse(spark, d), keep=["event_id"])
    return cv.reassemble_chunks(chunks, "id", "event_id", part_size=5)


# --------------------------------------------------------------------- run log

#: each user is a run, the day of the week is the step
def step_events(spark, d):
    t = F.col("event_type")
    event = F.when(t == "error", "failed").when(t == "purchase", "completed").otherwise("started")
    steps = F.array(*[F.lit(s) for s in rl.TRACKED_STEPS])
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.element_at(steps, F.dayofweek("ts")).alias("step"), event.alias("event"), "ts",
        F.when(t == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"),
        F.create_map(t, F.col("event_id").cast("string")).alias("metadata"))


_STEPS = ", ".join(f"'{s}'" for s in rl.TRACKED_STEPS)
STEP_EVENTS = f"""ev AS (SELECT user_id AS run_id, ([{_STEPS}])[dayofweek(ts) + 1] AS step, CASE event_type
  WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'started' END AS event, ts, event_id, event_type FROM events),
st AS MATERIALIZED (SELECT run_id, step, CASE arg_max(event, ts) WHEN 'started' THEN 'running' ELSE arg_max(event, ts) END AS status,
  max(ts) FILTER (WHERE event = 'started') AS start_time, max(ts) FILTER (WHERE event <> 'started') AS end_time,
  'e' || arg_max(event_id, ts) FILTER (WHERE event = 'failed') AS error FROM ev GROUP BY run_id, step)"""
_DUR = ("CASE WHEN end_time >= start_time THEN (epoch_us(end_time) - epoch_us(start_time)) / 1e6 END")


@query("step_status", f"""WITH {STEP_EVENTS}, md AS (SELECT run_id, step, event_type AS k, CAST(arg_max(event_id, ts) AS VARCHAR) AS v
  FROM ev GROUP BY run_id, step, event_type),
mm AS (SELECT run_id, step, string_agg(k || '=' || v, ',' ORDER BY k) AS metadata FROM md GROUP BY run_id, step)
SELECT st.run_id, st.step, status, CAST(epoch_us(start_time) AS BIGINT) AS start_us, CAST(epoch_us(end_time) AS BIGINT) AS end_us,
  error, {_DUR} AS duration, metadata FROM st JOIN mm ON mm.run_id = st.run_id AND mm.step = st.step""")
def _(spark, d):
    s = rl.step_status(step_events(spark, d))
    return s.select(
        "run_id", "step", "status", F.unix_micros("start_time").alias("start_us"),
        F.unix_micros("end_time").alias("end_us"), "error", "duration",
        F.array_join(F.transform(F.map_entries("metadata"),
                                 lambda e: F.concat_ws("=", e.key, e.value)), ",").alias("metadata"))


PROGRESS = f"""pr AS (SELECT run_id, 7 AS total_steps, count(*) FILTER (WHERE status = 'completed') AS completed_steps,
  count(*) FILTER (WHERE status = 'failed') AS failed_steps, count(*) FILTER (WHERE status = 'running') AS running_steps,
  7 - count(*) AS pending_steps, min(start_time) AS a, max(greatest(start_time, end_time)) AS z FROM st GROUP BY run_id)"""
_PP = srnd("completed_steps / 7e0 * 100", 2)
_EL = "(epoch_us(z) - epoch_us(a)) / 1e6"


@query("progress_summary", f"""WITH {STEP_EVENTS}, {PROGRESS} SELECT run_id, total_steps, completed_steps, failed_steps,
  running_steps, pending_steps, {_PP} AS progress_percentage, {_EL} AS elapsed FROM pr""")
def _(spark, d):
    return rl.progress_summary(step_events(spark, d))


@query("step_rows", f"""WITH {STEP_EVENTS}, r AS (SELECT DISTINCT run_id FROM st),
w AS (SELECT i::INT - 1 AS step_no, ([{_STEPS}])[i] AS step FROM range(1, 8) t(i))
SELECT r.run_id, CAST(w.step_no AS INT) AS step_no, w.step, coalesce(status, 'pending') AS status, error, {_DUR} AS duration
FROM r JOIN w ON TRUE LEFT JOIN st ON st.run_id = r.run_id AND st.step = w.step""")
def _(spark, d):
    return rl.step_rows(step_events(spark, d)).drop("metadata")


@query("run_summary", f"""WITH {STEP_EVENTS}, {PROGRESS} SELECT run_id, completed_steps = 7 AS success,
  {_PP} AS success_rate, {_EL} AS total_duration, completed_steps, total_steps FROM pr""")
def _(spark, d):
    return rl.run_summary(step_events(spark, d))


# ------------------------------------------------------------------- streaming


def _event_stream(spark, d):
    """The events table as a stream of files, read as it arrives."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark):
    """State on the disks of the executors, not in their heaps."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _drain(spark, df, name: str, mode: str):
    """What a stream gives until its input is read, written by its tasks: no row passes through the driver."""
    place = scratch(spark, name)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "complete":  # files can only be added to, so a batch overwrites the one before
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{place}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{place}/out")
    with _rocks(spark):
        writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out")


@query("stream_step_status", f"""WITH {STEP_EVENTS} SELECT run_id, step, status, error, {_DUR} AS duration FROM st""")
def _(spark, d):
    t = F.col("event_type")
    event = F.when(t == "error", "failed").when(t == "purchase", "completed").otherwise("started")
    steps = F.array(*[F.lit(s) for s in rl.TRACKED_STEPS])
    stream = _event_stream(spark, d).select(
        F.col("user_id").alias("run_id"), F.element_at(steps, F.dayofweek("ts")).alias("step"),
        event.alias("event"), "ts",
        F.when(t == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    return _drain(spark, live.stream_step_status(stream, live.UNBOUNDED), "steps", "complete").select(
        "run_id", "step", "status", "error", "duration")


@query("stream_validation", """SELECT user_id AS sheet_id, 'negative' AS code, count(*) FILTER (WHERE value < 50e0) AS n
  FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE value < 50e0) > 0""")
def _(spark, d):
    path = scratch(spark, "history") + "/runs"

    def check(batch):
        found = va.rule_range(batch.withColumn("sheet_id", F.col("user_id")), {"value": (50, None)}, "sheet_id")
        return found

    q = live.stream_validation(_event_stream(spark, d), check, path, scratch(spark, "state"))
    q.awaitTermination()
    return src.read_history(spark, path).groupBy(F.col("sheet_id").cast("bigint").alias("sheet_id")).agg(
        F.lit("negative").alias("code"), F.sum(F.col("detail").cast("bigint")).alias("n"))


@query("stream_chunks", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id, event_type, ts,
    coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, FALSE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY id ORDER BY ts) AS session FROM e),
b AS (SELECT id, session, min(event_id) FILTER (WHERE event_type = 'error') AS stop_at, max(ts) + INTERVAL 6 HOUR AS closes
  FROM s GROUP BY id, session)
SELECT s.id, coalesce(string_agg(event_type || ' ', '' ORDER BY event_id) FILTER (WHERE stop_at IS NULL OR event_id < stop_at), '')
  AS content, count(*) FILTER (WHERE stop_at IS NULL OR event_id < stop_at) AS chunks,
  any_value(stop_at IS NOT NULL) AS finished
FROM s JOIN b ON b.id = s.id AND b.session = s.session
WHERE closes <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY s.id, s.session""")
def _(spark, d):
    t = F.col("event_type")
    stream = _event_stream(spark, d).select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"),
        F.concat(t, F.lit(" ")).alias("content"),
        F.when(t == "error", "stop").otherwise("null").alias("finish_reason"), "ts")
    replies = live.stream_chunks(stream, "6 hours", "1 hour")
    return _drain(spark, replies, "chunks", "append").drop("started")


@query("stream_replies", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id, event_type FROM events),
s AS (SELECT id, min(event_id) FILTER (WHERE event_type = 'error') AS stop_at FROM e GROUP BY id)
SELECT e.id, coalesce(string_agg(event_type || ' ', '' ORDER BY event_id) FILTER (WHERE stop_at IS NULL OR event_id < stop_at), '')
  AS content, count(*) FILTER (WHERE stop_at IS NULL OR event_id < stop_at) AS chunks, any_value(stop_at IS NOT NULL) AS finished
FROM e JOIN s ON s.id = e.id GROUP BY e.id""")
def _(spark, d):
    t = F.col("event_type")
    chunks = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.concat(t, F.lit(" ")).alias("content"),
        F.when(t == "error", "stop").otherwise("null").alias("finish_reason"), "ts")
    place = scratch(spark, "replies")
    chunks.write.parquet(f"{place}/in")
    # a last event, years later, moves the watermark beyond all gaps
    chunks.agg(F.lit("end").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("content"),
               F.lit("null").alias("finish_reason"), (F.max("ts") + F.expr("INTERVAL 5000 DAYS")).alias("ts")) \
        .write.mode("append").parquet(f"{place}/in")
    with _rocks(spark):
        files = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1000).parquet(f"{place}/in")
        (live.stream_replies(files, "4000 days", "1 hour").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out").awaitTermination())
    return spark.read.schema(live.REPLY).parquet(f"{place}/out").where("id <> 'end'")

"""Messages, replies, chunks, run log and streams."""

import random

from pyspark.sql import functions as F

from sheetloom.operators import conversation as cv
from sheetloom.operators import runlog as rl
from sheetloom.sources import sheets as src
from sheetloom.streaming import live


def test_advice_lines(spark):
    df = spark.createDataFrame([("1. [高] 修复空值\n说明\n- 统一格式\n6. no",), ("nothing",)], "text string")
    assert [r.recommendation for r in cv.parse_recommendations(df).collect()] == [
        "[高] 修复空值", "统一格式", cv.NO_ADVICE]


def test_reply_format(spark):
    df = spark.createDataFrame([("a. b",), ("x\n\n\n```  c. d ```",)], "text string")
    assert [r.formatted for r in cv.format_replies(df).collect()] == ["a.\nb", "x\n\n```\nc. d\n```"]


def test_think_tags(spark):
    df = spark.createDataFrame([("<think>t</think>a ",)], "text string")
    assert cv.rewrite_think_tags(df).first().rewritten == "**思考过程**：\nt\n\n**最终回复**：\na"


def test_events_and_chunks(spark):
    line = lambda c, f: f'data: {{"code": 200, "data": {{"id": "x", "content": "{c}", "finishReason": "{f}"}}}}'
    rows = [(0, line("He", "null")), (1, line("llo", "null")), (2, line("", "stop")),
            (3, line("late", "null")), (4, "data: oops"), (5, "")]
    df = spark.createDataFrame(rows, "seq int, line string")
    events = cv.decode_events(df, keep=["seq"])
    assert events.count() == 4
    r = cv.reassemble_chunks(events).first()
    assert (r.content, r.chunks, r.finished) == ("Hello", 2, True)
    parts = cv.reassemble_chunks(events, part_size=1).orderBy("part").collect()
    assert [p.content for p in parts] == ["He", "llo", ""]


def test_json_with_a_tail_is_no_json(spark):
    from sheetloom.functions.exprs import one_json_value

    good = ['{"a": 1}', " [1, 2] ", '"x"', "{}", '{"a": {"b": [1]}}']
    bad = ['{"a": 1} x', '{"a": 1}{"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1}, "b": 2', "{", "", None, "1] , [2"]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    kept = {r.t for r in df.where(one_json_value(F.col("t")).isNotNull()).collect()}
    assert kept == set(good)
    line = 'data: {"data": {"id": "x", "content": "c", "finishReason": "null"}} {"more": 1}'
    assert cv.decode_events(spark.createDataFrame([(line,)], "line string")).count() == 0


def test_long_replies_are_put_together_in_parts(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for name, n in (("hot", 4000), ("warm", 300), ("cold", 20), ("open", 900), (None, 700), ("ends", 200)):
        order = rng.sample(range(10 * n), n)
        order[1] = order[0]  # a tie
        stops = {"hot": {order[n // 3]}, "ends": {max(order)}, None: {min(order)}}.get(name, set())
        rows += [(name, o, rng.choice(["a", "bc", "", None]), "stop" if o in stops else "null") for o in order]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, seq int, content string, finish_reason string").repartition(4)
    plain = sorted(map(str, cv.reassemble_chunks(df).collect()))
    talks = sorted(map(str, cv.assemble_messages(df, "id", "seq", ("content",)).collect()))
    monkeypatch.setattr(cv, "PART_ROWS", 250)
    assert sorted(map(str, cv.reassemble_chunks(df).collect())) == plain
    assert sorted(map(str, cv.assemble_messages(df, "id", "seq", ("content",)).collect())) == talks
    got = {r.id: r for r in cv.reassemble_chunks(df).collect()}
    for name, r in got.items():
        own = sorted((o, c or "", f == "stop") for i, o, c, f in rows if i == name)
        stop = min((o for o, _, s in own if s), default=None)
        kept = [c for o, c, s in own if not s and (stop is None or o < stop)]
        assert (r.part, r.content, r.chunks, r.finished) == (0, "".join(kept), len(kept), stop is not None), name


def test_no_task_gathers_a_hot_reply(spark, monkeypatch):
    monkeypatch.setattr(cv, "PART_ROWS", 1000)
    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
                                   F.col("id").alias("seq"), F.lit("x").alias("content"))

    def fold(items):
        return F.struct(F.size(items).alias("n"), F.array_join(F.transform(items, lambda i: i["x"]), "").alias("t"))

    def merge(parts):
        return F.struct(F.array_max(F.transform(parts, lambda p: p["n"])).alias("n"),
                        F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("t"))

    found = cv.gather_ordered(df, "id", "seq", F.col("content"), fold, merge).where("id = 'hot'").first().value
    assert found.t == "x" * 20000 and found.n <= 2 * cv.PART_ROWS


def test_hot_reply_is_whole(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("seq"), F.lit("x").alias("content"),
        F.when(F.col("id") == 8000, "stop").otherwise("null").alias("finish_reason"))
    parts = cv.reassemble_chunks(df, part_size=500).where("id = 'hot'").collect()
    assert sum(p.chunks for p in parts) == sum(len(p.content) for p in parts) == 3000
    assert max(p.chunks for p in parts) <= 500


def test_long_conversation_comes_in_parts(spark):
    df = spark.range(2500).select(F.lit("c").alias("conv"), F.col("id").alias("turn"),
                                  F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    (whole,) = cv.assemble_messages(df, "conv", "turn").collect()
    assert whole.message_count == 2500 and whole.messages[2499].text == "2499"
    times = df.withColumn("turn", F.col("turn") * 977)
    assert [r.position for r in cv.long_messages(times, "conv", "turn").orderBy("turn").collect()] == list(range(2500))
    df = times
    parts = cv.assemble_messages(df, "conv", "turn", part_size=1024).orderBy("part").collect()
    assert [p.message_count for p in parts] == [1024, 1024, 452]
    assert parts[1].messages[0].text == "1024"
    assert cv.last_message(df, "conv", "turn").first().last_text == "2499"


STEPS = list(rl.TRACKED_STEPS)


def events(spark):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = []
    for i, s in enumerate(STEPS[:4]):
        rows += [("r", s, "started", t(2 * i), None), ("r", s, "completed", t(2 * i + 1), None)]
    rows += [("r", STEPS[4], "started", t(20), None), ("r", STEPS[4], "failed", t(22), "boom"),
             ("r", STEPS[5], "started", t(30), None), ("r", "update_iteration", "started", t(31), None)]
    return spark.createDataFrame(rows, "run_id string, step string, event string, ts string, error string").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def test_progress(spark):
    r = rl.progress_summary(events(spark)).first()
    assert (r.completed_steps, r.failed_steps, r.running_steps, r.pending_steps) == (4, 1, 1, 1)
    assert r.progress_percentage == 57.14 and r.elapsed == 31 * 60
    assert rl.run_summary(events(spark)).first().success is False
    failed = rl.step_status(events(spark)).where("status = 'failed'").first()
    assert (failed.error, failed.duration) == ("boom", 120.0)


def test_metadata_merges_by_time(spark):
    e = events(spark).where("step = 'classify_fields'").withColumn(
        "metadata", F.when(F.col("event") == "started", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")))
        .otherwise(F.create_map(F.lit("a"), F.lit("2"))))
    assert rl.step_status(e).first().metadata == {"a": "2", "b": "1"}


def drain(df, name, mode, path):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", path).trigger(availableNow=True).start())
    q.awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    drain(live.stream_step_status(stream, live.UNBOUNDED), "live_steps", "complete", str(tmp_path / "c"))
    key = lambda rows: sorted(map(str, rows))
    batch = rl.step_status(e)
    assert key(spark.table("live_steps").select(*batch.columns).collect()) == key(batch.collect())


def test_idle_steps_leave_the_state(spark, tmp_path):
    e = events(spark)
    late = e.limit(1).withColumn("ts", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "ev/a"))
    late.coalesce(1).write.parquet(str(tmp_path / "ev/b"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev/*"))
    drain(live.stream_step_status(stream, idle="1 hour"), "idle_steps", "append", str(tmp_path / "c"))
    got = {r.step: r.status for r in spark.table("idle_steps").collect()}
    assert got == {r.step: r.status for r in rl.step_status(e).collect()}


def test_stream_chunks(spark, tmp_path):
    rows = [("a", 0, "He", "null", "00:00:00"), ("a", 1, "llo", "null", "00:00:05"), ("a", 2, "", "stop", "00:00:06"),
            ("a", 3, "late", "null", "00:00:07"), ("b", 0, "Hi", "null", "00:00:02"), ("z", 0, "", "null", "09:00:00")]
    df = spark.createDataFrame(rows, "id string, seq int, content string, finish_reason string, t string").select(
        "id", "seq", "content", "finish_reason",
        F.concat(F.lit("2024-01-01 "), "t").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "ch"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ch"))
    drain(live.stream_chunks(stream), "live_chunks", "append", str(tmp_path / "c"))
    got = {r.id: (r.content, r.finished) for r in spark.table("live_chunks").collect()}
    assert got == {"a": ("Hello", True), "b": ("Hi", False)}


def test_stream_validation_appends_per_batch(spark, tmp_path):
    df = spark.createDataFrame([("s", 1), ("s", -1)], "sheet_id string, v int")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    check = lambda b: b.where("v < 0").select("sheet_id", F.lit("negative").alias("code"))
    live.stream_validation(stream, check, str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination()
    assert [r.code for r in src.read_history(spark, str(tmp_path / "h")).collect()] == ["negative"]


def test_history_survives_a_fresh_start(spark, tmp_path):
    df = spark.createDataFrame([("s", -1)], "sheet_id string, v int")
    df.write.parquet(str(tmp_path / "in"))
    check = lambda b: b.where("v < 0").select("sheet_id", F.lit("negative").alias("code"))
    for start in ("c1", "c2"):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        live.stream_validation(stream, check, str(tmp_path / "h"), str(tmp_path / start)).awaitTermination()
    runs = src.read_history(spark, str(tmp_path / "h"))
    assert runs.count() == 2 and runs.select("run_id").distinct().count() == 2
    assert dict(runs.dtypes)["run_id"] == "string"


def test_events_of_one_instant(spark):
    rows = [("r", "s", e, "2024-01-01 00:00:00", None) for e in ("completed", "started")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "run_id string, step string, event string, ts string, error string")
        assert rl.step_status(df).first().status == "completed"


def test_replies_leave_when_complete(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        n, start = rng.randint(1, 12), rng.randint(0, 1000)
        stop = rng.randint(0, n) if i % 3 else None
        for k in range(n + 1):
            if k == stop:
                rows.append((f"r{i}", k, "", "stop", start + k))
            elif k < n:
                rows.append((f"r{i}", k, rng.choice(["a", "bc", None]), "null", start + k))
    rows.sort(key=lambda r: r[4])
    later = ("later", 0, "x", "null", 100_000)  # moves the watermark beyond all others
    src_dir = tmp_path / "in"
    columns = "id string, seq int, content string, finish_reason string, s long"
    for batch in [rows[part::4] for part in range(4)] + [[later]]:  # batches overlap in time
        df = spark.createDataFrame(batch, columns)
        df.select("id", "seq", "content", "finish_reason", F.timestamp_seconds("s").alias("ts")).coalesce(1) \
            .write.mode("append").parquet(str(src_dir))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("id string, seq int, content string, finish_reason string, ts timestamp") \
            .option("maxFilesPerTrigger", 1).parquet(str(src_dir))
        q = (live.stream_replies(stream, "5 minutes", "30 minutes").writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")))
        q.awaitTermination()
    finally:
        spark.conf.unset(key)
    got = sorted((r.id, r.content, r.chunks, r.finished) for r in spark.read.schema(live.REPLY).parquet(str(tmp_path / "out")).collect())
    batch = cv.reassemble_chunks(spark.createDataFrame(rows, columns))
    assert got == sorted((r.id, r.content, r.chunks, r.finished) for r in batch.collect())

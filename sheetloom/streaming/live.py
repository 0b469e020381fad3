"""Live step states, batch-wise validation and chunk assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheetloom.operators.runlog import as_instant, status_aggregates, with_duration
from sheetloom.sources.sheets import append_history


UNBOUNDED = "unbounded"


def stream_step_status(stream: DataFrame, idle: str, late: str = "10 minutes") -> DataFrame:
    """Step states over a stream of events.

    A run's step leaves the state once no event came for ``idle``, and its final
    state is appended; a step that pauses longer comes out as two rows.  With
    ``UNBOUNDED`` every (run, step) stays in state and the result suits update or
    complete mode.
    """
    has_error = "error" in stream.columns
    if idle == UNBOUNDED:
        return with_duration(stream.groupBy("run_id", "step").agg(*status_aggregates(has_error)))
    timed = stream.withColumn("ts", as_instant(F.col("ts"))).withWatermark("ts", late)
    states = timed.groupBy("run_id", "step", F.session_window("ts", idle)).agg(
        *status_aggregates(has_error)
    )
    return with_duration(states).drop("session_window")


def stream_validation(stream: DataFrame, check: Callable[[DataFrame], DataFrame], path: str,
                      checkpoint: str, once: bool = True) -> StreamingQuery:
    """Validates every arriving batch and appends its findings to the history.

    ``check`` maps a batch of rows to findings.  The run id is that of the stream,
    which lives as long as its checkpoint, with the batch id: a batch that is
    replayed after a failure overwrites its own partition, and a stream started
    afresh adds to the history.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_history(check(batch), path, f"{stream_id}-{batch_id:09d}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_chunks(stream: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Replies put together from a stream of (id, seq, content, finish_reason, ts).

    One row per reply: it closes once no chunk came for ``gap``; what follows its
    stop marker is dropped.  Append mode; finished replies leave the state.
    Replies still open at the end of the input stay in the state.
    """
    timed = stream.withColumn("ts", as_instant(F.col("ts"))).withWatermark("ts", late)
    item = F.struct("seq", "content", "finish_reason")
    grouped = timed.groupBy("id", F.session_window("ts", gap)).agg(
        F.array_sort(F.collect_list(item)).alias("__c"),
        F.min(F.when(F.col("finish_reason") == "stop", F.col("seq"))).alias("stop_at"),
    )
    kept = F.filter(
        "__c",
        lambda x: (F.col("stop_at").isNull() | (x.seq < F.col("stop_at"))),
    )
    return grouped.select(
        "id", F.col("session_window.start").alias("started"),
        F.array_join(F.transform(kept, lambda x: x.content), "").alias("content"),
        F.size(kept).cast("long").alias("chunks"),
        F.col("stop_at").isNotNull().alias("finished"),
    )


REPLY = "id string, content string, chunks long, finished boolean"


def _reply_processor(gap_ms: int):
    """Keeps a reply's chunks until its stop marker, or until no chunk came for ``gap_ms`` of event time."""
    # named inside a function, so that workers need not find this package
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Replies(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.chunks = handle.getListState("chunks", "seq long, content string")
            # when the last chunk came, the place of the stop marker, and whether the reply has left
            self.known = handle.getValueState("known", "last long, stop long, left boolean")

        def _wake(self, at: int) -> None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

        def handleInputRows(self, key, rows, timerValues):
            last, stop, left = self.known.get() if self.known.exists() else (0, None, False)
            new, stopped_at = [], None
            for frame in rows:
                for seq, content, finish, ms in zip(frame["seq"], frame["content"], frame["finish_reason"], frame["ms"]):
                    last = max(last, int(ms))
                    if finish == "stop":
                        if stop is None or seq < stop:
                            stop, stopped_at = int(seq), int(ms)
                    elif not left:
                        new.append((int(seq), content if isinstance(content, str) else ""))
            if new:
                self.chunks.appendList(new)
            # all that came before the marker is there once the watermark has passed it; what has left is remembered
            # for a while, so that late chunks don't start it again
            due = stopped_at if stop is not None and not left and stopped_at is not None else None
            if due is None and stop is not None and not left:
                due = next(iter(self.handle.listTimers()), last)
            self._wake(max(due if due is not None else last + gap_ms, timerValues.getCurrentWatermarkInMs() + 1))
            self.known.update((last, stop, left))
            yield pd.DataFrame()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last, stop, left = self.known.get()
            if left:
                self.known.clear()
                yield pd.DataFrame()
                return
            kept = sorted(c for c in self.chunks.get() if stop is None or c[0] < stop)
            self.chunks.clear()
            if stop is None:
                self.known.clear()
            else:
                self.known.update((last, stop, True))
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + gap_ms)
            yield pd.DataFrame({"id": [key[0]], "content": ["".join(c[1] for c in kept)], "chunks": [len(kept)],
                                "finished": [stop is not None]})

        def close(self) -> None:
            pass

    return Replies()


def stream_replies(stream: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Replies from a stream of (id, seq, content, finish_reason, ts), each as soon as it is complete.

    A reply leaves when the watermark passes its stop marker, with the chunks before it.  One without a marker leaves
    by a timer, open, once no chunk came for ``gap``.  Chunks that come later for a reply that has left are dropped
    for another ``gap``.  Append mode; needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    wait = stream.sparkSession.sql(f"SELECT CAST(unix_millis(timestamp_millis(0) + INTERVAL {gap}) AS BIGINT) AS ms").first()
    timed = stream.withColumn("ts", as_instant(F.col("ts"))).withWatermark("ts", late)
    rows = timed.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), "content",
                        "finish_reason", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("id").transformWithStateInPandas(_reply_processor(wait["ms"]), REPLY, "append", "eventTime")

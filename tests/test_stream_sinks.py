"""Queries on streams: their rows are written by tasks and never gathered by the driver."""

from datetime import datetime, timedelta

import pytest

from checks import texts


@pytest.fixture
def few_events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    kinds = ("view", "click", "error", "purchase")
    rows = [(i, start + timedelta(hours=i), i % 7, kinds[i % 4], float(i), "{}") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_chunks", "stream_step_status"])
def test_no_row_of_a_stream_stays_on_the_driver(spark, few_events, name):
    tables = {t.name for t in spark.catalog.listTables()}
    got = texts.QUERIES[name](spark, few_events)
    assert got.inputFiles() and got.count() > 0
    assert {t.name for t in spark.catalog.listTables()} == tables  # a memory sink leaves a table of all rows
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != texts.ROCKS

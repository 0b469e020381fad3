"""Texts that hold JSON: strictness against Python's reader, repeated keys, tails."""

import json
import random

from pyspark.sql import functions as F

from sheetloom.functions.exprs import json_object, one_json_value
from sheetloom.operators import conversation as cv
from sheetloom.operators import mapping as mp
from sheetloom.operators import validation as va


def test_one_value_is_what_python_reads(spark):
    rng = random.Random(2)
    parts = ['{"a":1}', '{"a":1,"a":"x"}', '{"a":NaN}', "[1,2]", '{"a":{"b":[1,"]}"]}}', "12", '"s"', "null", "true", "{}",
             "-Infinity", '{"a":"\\"}"}', '{"a":"\\\\"}']
    tails = ["", " ", "\n", "]", "}", ",", ", 1", ',"b":2', "x", '{"b":2}', ",0]", "],[1", "//c", '"', "\\", "[", "}{"]
    texts = [h + p + t for p in parts for t in tails for h in ("", " ")]
    texts += ["".join(rng.choice('{}[]",:1a \\') for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    texts += ["{'a':1}", '{"a":01}', "{a:1}", '{"a":1,}', '{"a":"x\ny"}', ""]

    def reads(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in set(texts)], "t string").repartition(4)
    kept = {r.t for r in df.where(one_json_value(F.col("t")).isNotNull()).collect()}
    assert kept == {t for t in texts if reads(t)}


def test_the_last_of_repeated_keys_is_kept(spark):
    texts = ['{"a":1,"b":2,"a":3}', '{"a":1}', "{}", "[1]", "null", None, '{"a":null,"a":null}', '{"a":{"x":1}}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(json_object(F.col("t")).alias("m")).collect()]
    assert got == [{"a": "3", "b": "2"}, {"a": "1"}, {}, None, None, None, {"a": None}, {"a": '{"x":1}'}]


def test_replies_with_repeated_keys_and_other_objects(spark):
    replies = {
        "again": '{"mapping": {"订单号": "a", "订单号": "b", "重量": NaN}}',
        "twice": '{"mapping": {"件数": "x"}, "mapping": {"件数": "y"}}',
        "tail": '{"订单号": "a"} } 订单号: t',
        "two": 'first {"订单号": "a"} then {"订单号": "b"}',
        "text": '{"mapping": "{\\"订单号\\": \\"no\\"}", "件数": "n"}',
        "fenced": 'use {braces}\n```json\n{"mapping": {"车型": "f"}}\n```\nend }',
        "plain": 'a } b\n```\n{"路顺": "p"}\n```',
        "list": '["订单号"] 订单号: "l"',
    }
    df = spark.createDataFrame(list(replies.items()), "sheet_id string, text string")
    got = {}
    for r in mp.parse_proposals(df).collect():
        if r.column:
            got.setdefault(r.sheet_id, {})[r.std_field] = r.column
    assert got == {"again": {"订单号": "b", "重量": '"NaN"'}, "twice": {"件数": "y"}, "tail": {"订单号": "t"},
                   "text": {"件数": "n"}, "fenced": {"车型": "f"}, "plain": {"路顺": "p"}, "list": {"订单号": "l"}}
    pairs = {(r.sheet_id, r.std_field, r.column) for r in mp.extract_mapping_object(df).collect()}
    assert pairs == {("again", "订单号", "b"), ("again", "重量", '"NaN"'), ("twice", "件数", "y")}


def test_kinds_of_replies(spark):
    replies = {"gone": None, "nothing": '{"mapping": {}}', "some": '{"mapping": {"订单号": "a"}}', "lines": "hello",
               "missing": '{"订单号": null}'}
    df = spark.createDataFrame(list(replies.items()), "sheet_id string, text string")
    assert {r.sheet_id: r.reply for r in mp.reply_kinds(df).collect()} == {
        "gone": "none", "nothing": "empty", "some": "mapping", "lines": "mapping", "missing": "mapping"}


def test_event_lines_with_repeated_keys(spark):
    lines = ['data: {"data": {"id": "x", "content": "a", "content": "b", "finishReason": "null"}}',
             'data: {"code": NaN, "data": {"id": "y", "content": "c"}}', 'data: {"data": {"id": "z"}} x', "data: [1]"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted((r.id, r.content) for r in cv.decode_events(df).collect()) == [("x", "b"), ("y", "c")]


def test_payloads_with_repeated_keys(spark):
    df = spark.createDataFrame([
        ("again", '{"filename": "f", "total_rows": "x", "total_rows": 2, "columns": [], "data": [{"a": 1, "a": NaN}]}'),
        ("double", '{"filename": "f", "total_rows": 2.5, "columns": {}, "data": "d"}')], "sheet_id string, p string")
    got = {(r.sheet_id, r.subject) for r in va.check_envelope(df, "p").collect()}
    assert got == {("double", "total_rows"), ("double", "columns"), ("double", "data")}
    rows = spark.createDataFrame([("s", 0, '{"a": 1, "a": NaN}'), ("s", 1, '{"a": 1} {"b": 2}')],
                                 "sheet_id string, i int, p string")
    got = {(r.subject, r.code, r.detail) for r in va.row_conformance(rows, "p", ["a", "b"], "i").collect()}
    assert got == {("0", "missing_columns", "b"), ("1", "row_not_object", "not an object")}

"""From replies, files and raw headers to a mapping."""

from pyspark.sql import functions as F

from sheetloom.operators.profiling import profile_cells
from sheetloom.plans.onboarding import map_fields, onboard
from sheetloom.sources.cells import read_cells

SHEET = {"订单编号": ["ORD1", "ORD2", "ORD3"], "发货日期": ["2024-01-01"] * 3, "货物总重": [1.5, 2.5, 3.5], "承运方": ["a", "b", "a"],
         "客户名称": ["x", "y", "z"]}


def test_replies_decide_what_comes_first(spark, cells):
    profiles = profile_cells(cells({name: SHEET for name in ("said", "empty", "silent", "null")}))
    replies = spark.createDataFrame([
        ("said", '{"mapping": {"订单号": "发货日期", "车型": "missing"}}'), ("empty", '{"映射结果": {}} 车型: 承运方\n'),
        ("null", None), ("other", '{"订单号": "x"}')], "sheet_id string, text string")
    got = {}
    for r in map_fields(profiles, replies=replies).where("column IS NOT NULL").collect():
        got.setdefault(r.sheet_id, {})[r.std_field] = (r.column, r.stage)
    plain = {}
    for r in map_fields(profiles).where("column IS NOT NULL").collect():
        plain.setdefault(r.sheet_id, {})[r.std_field] = (r.column, r.stage)
    assert got["silent"] == plain["silent"] and got["null"] == plain["null"] and "other" not in got
    assert {s for _, s in plain["silent"].values()} >= {"rules", "keywords"}
    # what the reply proposes stays, and no rule or keyword comes in
    assert got["said"]["订单号"] == ("发货日期", "proposal")
    assert {s for _, s in got["said"].values()} == {"proposal", "similarity"}
    assert got["empty"]["车型"] == ("承运方", "proposal")
    assert {s for _, s in got["empty"].values()} == {"proposal", "rules"}


def test_files_are_onboarded(spark, tmp_path):
    (tmp_path / "正 常.csv").write_text("订单编号,发货日期\nORD1,2024-01-01\nORD2,2024-01-02\n", encoding="utf-8")
    (tmp_path / "title.csv").write_text(",,\n报表,,\n,,\n订单编号,发货日期,件数\nORD1,2024-01-01,3\nORD2,2024-01-02,4\n", encoding="utf-8")
    mapping, confidence = onboard(read_cells(spark, str(tmp_path)))
    got = {(r.sheet_id, r.std_field): r.column for r in mapping.where("column IS NOT NULL").collect()}
    assert got["正 常.csv", "订单号"] == got["title.csv", "订单号"] == "订单编号"
    assert got["title.csv", "件数"] == "件数" and got["title.csv", "运输日期"] == "发货日期"
    assert confidence.where(F.col("confidence") > 0).count() == 2


def test_replies_are_computed_once(spark, cells):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def reply(sheet):
        read.add(1)
        return '{"mapping": {}}' if sheet == "b" else '{"mapping": {"订单号": "发货日期"}}'

    profiles = profile_cells(cells({name: SHEET for name in ("a", "b", "c")}))
    sheets = spark.createDataFrame([("a",), ("b",), ("c",)], "sheet_id string")
    map_fields(profiles, replies=sheets.select("sheet_id", reply.asNondeterministic()("sheet_id").alias("text"))).collect()
    assert read.value == 3

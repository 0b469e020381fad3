"""Structure, content and rule checks; reports."""

from pyspark.sql import functions as F

from sheetloom.operators import validation as va
from sheetloom.plans.quality import nested_report, quality_report


def test_structure_scores(spark):
    meta = spark.createDataFrame(
        [("five", 5), ("none", 0), ("many", 50), ("gone", 50)], "sheet_id string, total_rows long")
    found = spark.createDataFrame(
        [("many", "structure", "error", "a", "not_a_list", ""),
         ("many", "structure", "warning", "b", "extra_columns", ""),
         ("gone", "structure", "error", "data", "missing_key", "")],
        "sheet_id string, step string, severity string, subject string, code string, detail string")
    got = {r.sheet_id: r.data_quality_score for r in va.structure_score(found, meta).collect()}
    assert got == {"five": 80.0, "none": 0.0, "many": 75.0, "gone": 0.0}


def test_envelope(spark):
    docs = {
        "ok": '{"filename": "f", "total_rows": 2, "columns": ["a"], "data": []}',
        "text_rows": '{"filename": "f", "total_rows": "2", "columns": [], "data": []}',
        "negative": '{"filename": "f", "total_rows": -1, "columns": [], "data": []}',
        "text_list": '{"filename": "f", "total_rows": 1, "columns": "[a", "data": {}}',
        "gap": '{"filename": "f", "columns": 1}',
        "broken": "nope",
    }
    df = spark.createDataFrame(list(docs.items()), "sheet_id string, p string")
    got = {}
    for r in va.check_envelope(df, "p").collect():
        got.setdefault(r.sheet_id, set()).add((r.subject, r.code))
    assert got == {
        "text_rows": {("total_rows", "bad_total_rows")},
        "negative": {("total_rows", "bad_total_rows")},
        "text_list": {("columns", "not_a_list"), ("data", "not_a_list")},
        "gap": {("total_rows", "missing_key"), ("data", "missing_key")},
        "broken": {(k, "missing_key") for k in va.ENVELOPE_KEYS},
    }


def test_rows_ignore_the_label_column(spark):
    df = spark.createDataFrame(
        [("s", 0, '{"a": 1, "b": 2, "sheet": "x"}'), ("s", 1, '{"a": 1, "c": 2}'), ("s", 2, "[1]")],
        "sheet_id string, i int, p string")
    got = {(r.subject, r.code, r.detail) for r in
           va.row_conformance(df, "p", ["a", "b"], "i").collect()}
    assert got == {("1", "missing_columns", "b"), ("1", "extra_columns", "c"),
                   ("2", "row_not_object", "not an object")}


def test_content_findings_match_a_second_pass(spark, cells):
    values = {"s": {"far": [0] * 19 + [100], "mixed": [1, "a"] * 10, "gap": [None] * 11 + ["x"] * 9,
                    "fine": list(range(20))}}
    got = {(r.subject, r.code) for r in va.content_check(cells(values)).collect()}
    assert got == {("far", "outliers"), ("mixed", "mixed_types"), ("gap", "high_null_rate")}


def test_sheet_without_cells_is_an_error(spark, cells):
    meta = spark.createDataFrame([("s", 2), ("void", 0)], "sheet_id string, total_rows long")
    findings, steps = va.validate_all(cells({"s": {"a": [1, 2]}}), meta)
    assert [(r.sheet_id, r.code) for r in findings.collect()] == [("void", "no_data")]
    got = {(r.sheet_id, r.step): (r.is_valid, r.score) for r in steps.collect()}
    assert got["void", "content"] == (False, 0.0) and got["s", "content"] == (True, 100.0)
    summary = {r.sheet_id: r for r in va.validation_summary(steps).collect()}
    assert summary["void"].overall_status == "失败" and summary["s"].passed_steps == 2


def test_declared_rules(spark):
    df = spark.createDataFrame(
        [("ORD1", "5", "2024-01-01"), ("X", "a", "soon"), (None, "2000", "")],
        "no string, w string, d string")
    found = lambda x: {(r.subject, r.code, r.detail) for r in x.collect()}
    assert found(va.rule_required(df, ["no", "d", "zz"])) == {
        ("no", "required", "1"), ("d", "required", "1"), ("zz", "required", "3")}
    assert found(va.rule_types(df, {"w": "numeric", "d": "date"})) == {
        ("w", "not_numeric", "1"), ("d", "not_date", "1")}
    assert found(va.rule_range(df, {"w": (0, 1000)})) == {("w", "out_of_range", "1")}
    assert found(va.rule_pattern(df, {"no": r"^ORD\d+$"})) == {("no", "pattern", "1")}
    assert found(va.rule_custom(df, {"short": "length(no) < 3"})) == {("short", "custom", "2")}


def test_grades(spark):
    df = spark.createDataFrame([(90.0,), (89.9,), (70.0,), (60.0,), (1.0,)], "score double")
    assert [r.grade for r in va.quality_grade(df).collect()] == ["优秀", "良好", "一般", "较差", "很差"]
    four = spark.createDataFrame([(1.0, 0.5, 1.0, 0.0)],
                                 "completeness double, consistency double, accuracy double, mapping double")
    assert va.composite_score(four).first().composite == 62.5


def test_report_sections(spark):
    df = spark.range(40).select(
        F.when(F.col("id") < 20, "a").otherwise("b").alias("g"), "id",
        F.when(F.col("id") % 10 == 0, F.lit("x")).alias("mostly_null"))
    sections = quality_report(df, "g", "id")
    # the first cell of ``a`` is a text, nine in ten others are null: (0.1 + 1) / 2 < 0.7
    assert {(r.sheet_id, r.subject, r.code) for r in sections["recommendations"].collect()} == {
        ("a", "mostly_null", "high_null"), ("a", "sheet", "low_completeness"),
        ("a", "mostly_null", "low_consistency"), ("b", "mostly_null", "high_null"),
        ("b", "sheet", "low_completeness"), ("b", "mostly_null", "low_consistency")}
    nested = nested_report(sections).collect()
    assert len(nested) == 2 and nested[0].row_stats["max"] == 100.0

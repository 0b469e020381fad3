"""Hand-checked profile values, null policies, skew-independent results."""

import math

from pyspark.sql import functions as F

from sheetloom.operators import profiling as pr
from sheetloom.operators import reshape as rs
from sheetloom.operators.classify import classify, extract_keywords, importance


def test_column_types(cells):
    c = cells({"s": {"d": ["2024-01-01", "2024-01-02"], "m": [1, "a"], "n": [1, None],
                     "e": [None, None], "b": [True, False]}})
    types = {r.column: r.data_type for r in pr.infer_column_type(c).collect()}
    assert types == {"d": "date", "m": "text", "n": "numeric", "e": "text", "b": "text"}
    mixed = {r.column: r.kinds for r in pr.mixed_types(c).collect()}
    assert mixed == {"m": ["int", "text"]}


def test_format_consistency(spark):
    df = spark.createDataFrame([("ab",), ("abcd",)], "v string")
    assert pr.format_consistency(df).first().format_consistency == 0.8


def test_type_consistency_counts_nulls(cells):
    c = cells({"s": {"a": [1, None, "x", 2], "n": [None, 1, None, None]}})
    got = {r.column: (r.first_kind, r.type_consistency) for r in pr.type_consistency(c).collect()}
    assert got == {"a": ("int", 0.5), "n": ("null", 0.75)}


def test_outlier_case(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(19)] + [(19, 100.0)], "i int, v double")
    rows = pr.outliers_3sigma(df, "i").collect()
    assert [(r.i, r.value, r["mean"]) for r in rows] == [(19, 100.0, 5.0)]
    assert round(rows[0]["std"], 2) == 21.79


def test_row_completeness(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "a int, b string")
    r = pr.completeness_rows(df).first()
    assert (r["min"], r["max"], r["mean"], r["std"]) == (50.0, 100.0, 75.0, 25.0)
    assert pr.completeness_overall(df).first().overall == 75.0


def test_null_policies(spark):
    df = spark.createDataFrame([("", 1.0), (None, float("nan")), ("x", 2.0)], "t string, v double")
    blank = {r.column: r.null_count for r in pr.null_profile(df, nulls="blank").collect()}
    strict = {r.column: r.null_count for r in pr.null_profile(df, nulls="strict").collect()}
    assert blank == {"t": 2, "v": 1} and strict == {"t": 1, "v": 1}
    for nulls, base in (("blank", blank), ("strict", strict)):
        for r in pr.uniqueness(df, nulls=nulls).collect():
            assert r.non_null + base[r.column] == r.total_rows == 3


def test_empty_frame_has_null_metrics(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert pr.null_profile(df).first().null_rate is None
    assert pr.completeness_overall(df).first().overall is None
    assert pr.profile_columns(df).count() == 0


def test_exact_and_sketch_agree(spark):
    df = spark.range(20000).select(
        (F.col("id") % 3).cast("string").alias("g"), "id", (F.col("id") % 100).alias("m"))
    exact = {(r.g, r.column): r.distinct_count for r in pr.uniqueness(df, "g").collect()}
    rough = {(r.g, r.column): r.distinct_count for r in pr.uniqueness(df, "g", exact=False).collect()}
    for k, n in exact.items():
        assert abs(rough[k] - n) <= 0.1 * n


def test_corpus_equals_cells(spark):
    df = spark.range(500).select(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("sheet_id"), "id",
        F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("v"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.lit("2024-01-01")).alias("t"))
    wide = pr.profile_columns(df, "sheet_id")
    long = pr.profile_cells(rs.to_cells(df.withColumn("r", F.col("id")), "r", "sheet_id"))
    key = lambda r: (r.sheet_id, r.column)
    a = {key(r): tuple(r[c] for c in pr.PROFILE_COLUMNS) for r in wide.collect()}
    b = {key(r): tuple(r[c] for c in pr.PROFILE_COLUMNS) for r in long.collect()}
    assert a == b


def test_one_sheet_with_a_third_of_all_rows(spark):
    """A hot sheet changes no value of the others and is itself exact."""
    hot = spark.range(30000).select(F.lit("hot").alias("sheet_id"), (F.col("id") % 1000).alias("v"))
    cold = spark.range(60000).select(
        F.concat(F.lit("s"), (F.col("id") % 600).cast("string")).alias("sheet_id"),
        (F.col("id") % 17).alias("v"))
    both = {r.sheet_id: (r.total_rows, r.distinct_count)
            for r in pr.uniqueness(hot.unionByName(cold), "sheet_id").collect()}
    assert both["hot"] == (30000, 1000)
    assert len(both) == 601 and both["s0"] == (100, 17)


def test_headers_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1, None, "s")], "`a.b` int, `c d` string, sheet string")
    got = {r.column: r.null_count for r in pr.null_profile(df, "sheet").collect()}
    assert got == {"a.b": 0, "c d": 1}
    assert {r.column for r in pr.uniqueness(df, "sheet").collect()} == {"a.b", "c d"}


def test_classification(spark):
    rows = [("s", "创建时间", 0.5, "text", 0.0), ("s", "客户编号", 0.9, "text", 0.0),
            ("s", "客户编号", 0.5, "text", 0.0), ("s", "总重量", 0.2, "numeric", 0.6),
            ("s", "公司", 0.2, "text", 0.05), ("s", "x", 0.2, "date", 0.0), ("s", "z", 0.2, "text", 0.0)]
    p = spark.createDataFrame(
        rows, "sheet_id string, column string, uniqueness double, data_type string, null_rate double")
    assert [r.category for r in classify(p).collect()] == [
        "date", "identifier", "unknown", "quantity", "name", "date", "unknown"]
    scores = [round(r.importance_score, 2) for r in importance(p).collect()]
    assert scores == [0.45, 0.15, 0.25, 0.1, 0.25, 0.25, 0.25]
    assert [r.keywords for r in extract_keywords(p).collect()][3] == ["重量"]


def test_numeric_stats_of_one_row_has_no_deviation(spark):
    r = pr.numeric_stats(spark.createDataFrame([(5,)], "v int")).first()
    assert r["mean"] == 5.0 and r["std"] is None
    assert not math.isnan(r["min"])

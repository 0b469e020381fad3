"""Raw cells, sheets by name and inventories of files with unlike columns."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.sources import cells as cl
from sheetloom.sources import sheets as src


@pytest.fixture
def folder(tmp_path):
    def write(files):
        for name, text in files.items():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(text, encoding="utf-8", newline="")
        return str(tmp_path)

    return write


FILES = {
    "a/same.csv": "order,qty\nA,1\n,2.5\n",
    "b/same.csv": '\n  \nqty,order,qty\n1,A\n\n3,"B,""b""",true,extra\n',
    "a/x y/订单 1+2%.csv": '﻿订单号,"a,b",\r\n1,2,3\r\n',
    "a/empty.csv": "",
    "a/names.csv": "only,names",
}


def rows(df):
    return [tuple(r) for r in df.orderBy("sheet_id", "row_no", "col_no").collect()]


def test_cells_of_unlike_files(spark, folder):
    assert rows(cl.read_cells(spark, folder(FILES))) == [
        ("a/same.csv", 0, 0, "order", "A", "text"), ("a/same.csv", 0, 1, "qty", "1", "int"),
        ("a/same.csv", 1, 0, "order", None, "null"), ("a/same.csv", 1, 1, "qty", "2.5", "float"),
        ("a/x y/订单 1+2%.csv", 0, 0, "订单号", "1", "int"), ("a/x y/订单 1+2%.csv", 0, 1, "a,b", "2", "int"),
        ("a/x y/订单 1+2%.csv", 0, 2, None, "3", "int"),
        ("b/same.csv", 0, 0, "qty", "1", "int"), ("b/same.csv", 0, 1, "order", "A", "text"),
        ("b/same.csv", 2, 0, "qty", "3", "int"), ("b/same.csv", 2, 1, "order", 'B,"b"', "text"),
        ("b/same.csv", 2, 2, "qty", "true", "bool"), ("b/same.csv", 2, 3, None, "extra", "text")]


def test_cells_without_header(spark, folder):
    root = folder({"t.csv": "﻿x,1\n\n,y\n"})
    assert rows(cl.read_cells(spark, root, header=False)) == [
        ("t.csv", 0, 0, None, "x", "text"), ("t.csv", 0, 1, None, "1", "int"),
        ("t.csv", 2, 0, None, None, "null"), ("t.csv", 2, 1, None, "y", "text")]


def test_rows_of_a_file_in_many_blocks(spark, folder):
    rng = random.Random(4)
    body = {f"{n}.csv": [[str(i), rng.choice(["", "x" * rng.randrange(40), 'a,"b"'])] for i in range(n)] for n in (3, 400, 900)}
    texts = {}
    for name, values in body.items():
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["id", "note"], *values])
        texts[name] = out.getvalue()
    root, old = folder(texts), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert cl._blocks(cl._lines(spark, root, {})).count() > 20
        found = rows(cl.read_cells(spark, root))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == [(name, i, c, ("id", "note")[c], v or None, found[0][5] if c == 0 else "text" if v else "null")
                     for name in sorted(body) for i, row in enumerate(body[name]) for c, v in enumerate(row)]


def test_lines_are_cut_as_csv_does(spark):
    rng = random.Random(6)
    values = [[rng.choice(["", "a", 'q"', '""', ",", "a,b", '"x", y', " "]) for _ in range(rng.randint(1, 5))] for _ in range(500)]
    lines = []
    for row in values:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(row)
        lines.append(out.getvalue())
    lines += ['5" pipe,7', 'a;b,c']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = [r.v for r in df.orderBy("i").select(cl.split_line(F.col("t")).alias("v")).collect()]
    assert got[:500] == [next(csv.reader([x])) if x else [""] for x in lines[:500]]
    assert got[500:] == [['5" pipe', "7"], ["a;b", "c"]]


def test_records_with_unlike_keys(spark, folder):
    records = [{"b": 1, "a": "x"}, {"c": [1, {"k": None}], "b": 2.5}, {"a": None, "d": True}]
    text = "\n".join(json.dumps(r, ensure_ascii=False) for r in records)
    root = folder({"x/r.json": text + '\noops\n{"a": "é", "b": 1, "a": "z"}\n', "y/r.json": '{"q": "1"}'})
    want = {("x/r.json", i, c): v for i, r in enumerate(records) for c, v in r.items() if v is not None}
    want |= {("x/r.json", 4, "a"): "z", ("x/r.json", 4, "b"): 1, ("y/r.json", 0, "q"): "1"}
    found = rows(cl.read_cells(spark, root, "json"))
    assert [(c, n) for s, r, n, c, _, _ in found if (s, r) == ("x/r.json", 0)] == [("b", 0), ("a", 1), ("c", 2), ("d", 3)]
    assert len(found) == 4 * 4 + 1 and {r for s, r, *_ in found if s == "x/r.json"} == {0, 1, 2, 4}
    kinds = {int: "int", float: "float", bool: "bool", str: "text", list: "text"}
    shown = lambda v: json.dumps(v, separators=(",", ":")) if isinstance(v, (bool, list)) else str(v)
    assert {(s, r, c): (raw, k) for s, r, _, c, raw, k in found if raw is not None} == {
        key: (shown(v), kinds[type(v)]) for key, v in want.items()}
    listed = folder({"z/l.json": json.dumps(records, indent=1), "z/n.json": "{}"})
    again = rows(cl.read_cells(spark, listed + "/z", "json-list"))
    assert [x[1:] for x in again] == [x[1:] for x in found if x[0] == "x/r.json" and x[1] < 3]


def test_payloads_with_unlike_columns(spark):
    df = spark.createDataFrame([
        ("1", '{"b":[1,"x",null],"a":[1.5],"n":5,"c":[],"b":[true,{"k":1}]}'), ("2", '[{"u":1,"v":2},{"v":3,"w":4}]'),
        ("3", None), ("4", "x"), ("5", "{}"), ("6", "[]"), ("7", '{"a":[]}'), ("8", '{"a":[1]} tail')],
        "sheet_id string, payload string")
    assert rows(cl.payload_cells(df)) == [
        ("1", 0, 0, "b", "true", "bool"), ("1", 0, 1, "a", "1.5", "float"), ("1", 0, 2, "c", None, "null"),
        ("1", 1, 0, "b", '{"k":1}', "text"), ("1", 1, 1, "a", None, "null"), ("1", 1, 2, "c", None, "null"),
        ("2", 0, 0, "u", "1", "int"), ("2", 0, 1, "v", "2", "int"), ("2", 1, 0, "u", None, "null"),
        ("2", 1, 1, "v", "3", "int")]


def test_sheets_go_by_name(spark, folder):
    root = folder(FILES | {"c/Q.csv": "QTY,order,,order\n7,D,blank,twice\n"})
    df = src.read_sheets(spark, root, "csv")
    assert df.columns[:4] == ["sheet_id", "only", "names", "order"]
    got = {(r.sheet_id, r.order, r.qty) for r in df.collect()}
    assert got == {("a/same.csv", "A", "1"), ("a/same.csv", None, "2.5"), ("b/same.csv", "A", "1"),
                   ("b/same.csv", 'B,"b"', "3"), ("a/x y/订单 1+2%.csv", None, None), ("c/Q.csv", "D", "7")}
    assert [(r["列"], r.order_1) for r in df.where("sheet_id = 'c/Q.csv'").collect()] == [("blank", "twice")]
    typed = src.read_sheets(spark, [f"{root}/a/same.csv", f"{root}/b"], "csv", "qty int, missing string, order string")
    assert sorted((r.sheet_id, r.qty, r.missing, r.order or "") for r in typed.where("qty IS NOT NULL").collect()) == [
        ("a/same.csv", 1, None, "A"), ("b/same.csv", 1, None, "A"), ("b/same.csv", 3, None, 'B,"b"')]


def test_inventory_knows_each_files_columns(spark, folder, tmp_path):
    root = folder({f"csv/{k}": v for k, v in FILES.items()} | {"json/1 2.json": '{"a":1}\n{"b":2,"a":3}\nx\n', "json/0.json": "x"})
    got = {r.sheet_id: (r.bytes, r.row_count, r.column_count, r.columns) for r in
           src.file_inventory(spark, f"{root}/csv", "*.csv", "csv").collect()}
    size = {k: len(v.encode()) for k, v in FILES.items()}
    assert got == {
        "a/same.csv": (size["a/same.csv"], 2, 2, ["order", "qty"]),
        "b/same.csv": (size["b/same.csv"], 2, 3, ["qty", "order", "qty_1"]),
        "a/x y/订单 1+2%.csv": (size["a/x y/订单 1+2%.csv"], 1, 3, ["订单号", "a,b", "列"]),
        "a/names.csv": (size["a/names.csv"], 0, 2, ["only", "names"])}
    assert {r.sheet_id: (r.row_count, r.columns) for r in src.file_inventory(spark, f"{root}/json", "*", "json").collect()} == {
        "1 2.json": (2, ["a", "b"]), "0.json": (0, [])}
    for fmt in ("parquet", "orc"):
        place = f"{root}/{fmt}/部 分 %"
        spark.range(3).coalesce(1).write.format(fmt).save(f"{place}/x")
        spark.range(2).select(F.col("id").alias("k"), F.lit("v").alias("v")).coalesce(1).write.format(fmt).save(f"{place}/y")
        got = {r.sheet_id.rsplit("/", 1)[0]: (r.row_count, r.columns) for r in
               src.file_inventory(spark, f"{root}/{fmt}", f"*.{fmt}", fmt).collect()}
        assert got == {"部 分 %/x": (3, ["id"]), "部 分 %/y": (2, ["k", "v"])}
        both = src.read_sheets(spark, f"{root}/{fmt}", fmt)
        assert both.count() == 5 and set(both.columns) == {"sheet_id", "id", "k", "v"}

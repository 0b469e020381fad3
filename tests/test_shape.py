"""Header repair, caps, cells, files."""

import os

from pyspark.sql import functions as F

from sheetloom.operators import reshape as rs
from sheetloom.operators.profiling import profile_cells
from sheetloom.sources import sheets as src


def test_header_names(spark):
    h = spark.createDataFrame(
        [("s", 0, "a"), ("s", 1, "a "), ("s", 2, ""), ("s", 3, None), ("t", 0, "a"), ("t", 1, "a"),
         ("t", 2, "a_1")], "sheet_id string, col_no int, header string")
    got = {(r.sheet_id, r.col_no): r.column for r in rs.dedupe_headers(h).collect()}
    assert [got["s", i] for i in range(4)] == ["a", "a_1", "列", "列_1"]
    assert len({got["t", i] for i in range(3)}) == 3


def test_header_row_is_the_earliest_best(cells):
    rows = [None, "a", 1, "b"]
    c = cells({"s": {"Unnamed: 0": rows, "Unnamed: 1": [None, "x", "t", "y"]},
               "n": {"Unnamed: 0": [1, 2]}})
    assert [tuple(r) for r in rs.detect_header_row(c).collect()] == [("s", 1, 2)]
    out = rs.promote_header(c, rs.detect_header_row(c))
    got = {(r.sheet_id, r.row_no, r.column): r.raw for r in out.collect()}
    assert got == {("s", 0, "a"): "1", ("s", 0, "x"): "t", ("s", 1, "a"): "b", ("s", 1, "x"): "y",
                   ("n", 0, "Unnamed: 0"): "1", ("n", 1, "Unnamed: 0"): "2"}


def test_header_row_beyond_the_scan_is_ignored(cells):
    c = cells({"s": {"Unnamed: 0": [None] * 10 + ["late"]}})
    assert rs.detect_header_row(c).count() == 0


def test_sparse_columns(cells):
    blank = [""] * 95 + ["x"] * 5
    p = profile_cells(cells({"s": {"备注": blank, "仓库备注": blank, "full": ["x"] * 100}}))
    assert sorted(r.column for r in rs.drop_sparse(p).collect()) == ["full", "仓库备注"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(0, 1, "1", 5), (0, 1, "1", 5)], "z int, o int, t string, five int")
    assert [r.column for r in rs.drop_constant(df).collect()] == ["five"]


def test_caps_and_meta(spark):
    df = spark.range(250).select(F.when(F.col("id") < 200, "big").otherwise("small").alias("g"), "id")
    kept = rs.cap_rows(df, "g", "id", 100)
    assert {r.g: (r.n, r.m) for r in kept.groupBy("g").agg(
        F.count("id").alias("n"), F.max("id").alias("m")).collect()} == {
        "big": (100, 99), "small": (50, 249)}
    meta = {r.sheet_id: (r.original_rows, r.data_rows, r.truncated)
            for r in rs.sheet_meta(df, "g", 100).collect()}
    assert meta == {"big": (200, 100, True), "small": (50, 50, False), None: (250, 150, True)}
    shape = rs.frame_shape(df, 10, 1).first()
    assert (shape.original_rows, shape.kept_rows, shape.kept_cols, shape.truncated) == (250, 10, 1, True)


def test_cells_round_trip(spark):
    df = spark.createDataFrame([(0, "s", 1, "x"), (1, "s", None, "y")], "r int, g string, a int, b string")
    c = rs.to_cells(df, "r", "g")
    assert {(x.column, x.row_no): (x.raw, x.kind) for x in c.collect()} == {
        ("a", 0): ("1", "int"), ("b", 0): ("x", "text"), ("a", 1): (None, "null"), ("b", 1): ("y", "text")}
    back = rs.from_cells(c, ["a", "b"]).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in back] == [("1", "x"), (None, "y")]


def test_columnar_payload(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2], "skip")], "x array<string>, y array<int>, z string")
    got = [tuple(r) for r in src.columnar_to_rows(df).orderBy("row_no").collect()]
    assert got == [(0, "a", 1), (1, "b", 2)]


def test_files_in_and_out(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        with open(folder / f"{name}.csv", "w") as f:
            f.write("k,v\n" + "".join(f"{i},x{i}\n" for i in range(n)))
    df = src.read_sheets(spark, str(tmp_path / "in"), "csv")
    assert {r.sheet_id: r["count"] for r in df.groupBy("sheet_id").count().collect()} == {
        "a.csv": 3, "b.csv": 2}
    inventory = {r.file_name: (r.row_count, r.column_count) for r in
                 src.file_inventory(spark, str(tmp_path / "in"), "*.csv", "csv").collect()}
    assert inventory == {"a.csv": (3, 2), "b.csv": (2, 2)}
    out = str(tmp_path / "out")
    src.write_json(df, out, "sheet_id")
    assert sorted(p for p in os.listdir(out) if p.startswith("sheet_id")) == [
        "sheet_id=a.csv", "sheet_id=b.csv"]


def test_json_list_of_records(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"a": 1, "b": "x"}, {"a": null, "b": "y"}]')
    df = src.read_sheets(spark, str(tmp_path / "s.json"), "json", multiLine="true")
    assert sorted((r.a is None, r.b) for r in df.collect()) == [(False, "x"), (True, "y")]


def test_repeated_run_does_not_double_history(spark, tmp_path):
    f = spark.createDataFrame([("s", "x")], "sheet_id string, code string")
    path = str(tmp_path / "h")
    for run in ("r1", "r2", "r2"):
        src.append_history(f, path, run)
    history = src.read_history(spark, path)
    assert history.count() == 2
    assert [r.run_id for r in src.latest_history(history).collect()] == ["r2"]


def test_chained_header_repeats(spark):
    from sheetloom.operators import reshape

    headers = spark.createDataFrame(
        [("s", i, h) for i, h in enumerate(["a", "a", "a_1", "a_1_1", " ", None, "b"])],
        "sheet_id string, col_no int, header string")
    names = [r["column"] for r in reshape.dedupe_headers(headers).orderBy("col_no").collect()]
    assert len(set(names)) == 7 and names[:4] == ["a", "a_1", "a_1_1", "a_1_1_1"]


def test_every_sheet_gets_names(cells):
    from sheetloom.plans.onboarding import repair_headers

    c = cells({"healthy": {" order ": [1], "qty": [2], "qty\t": [3], "": [4]},
               "titled": {"Unnamed: 0": ["t", "a", "x"], "Unnamed: 1": [None, "a", "y"], "": [None, "unnamed", "z"]},
               "numbers": {"Unnamed: 0": [1, 2], "Unnamed: 1": [3, 4], " ": [5, 6]}})
    got = {}
    for r in repair_headers(c).orderBy("sheet_id", "row_no", "col_no").collect():
        got.setdefault((r.sheet_id, r.row_no), []).append((r.column, r.raw))
    assert got == {("healthy", 0): [("order", "1"), ("qty", "2"), ("qty_1", "3"), ("列", "4")],
                   ("titled", 0): [("a", "x"), ("a_1", "y"), ("列", "z")],
                   ("numbers", 0): [("Unnamed: 0", "1"), ("Unnamed: 1", "3"), ("列", "5")],
                   ("numbers", 1): [("Unnamed: 0", "2"), ("Unnamed: 1", "4"), ("列", "6")]}


def test_rows_as_maps_of_repeated_headers(spark):
    c = spark.createDataFrame([("s", 0, i, n, str(i), "int") for i, n in enumerate(["a", "a", "a_1", None, "列", "a"])],
                              "sheet_id string, row_no long, col_no int, column string, raw string, kind string")
    row = rs.from_cells(c).first().row
    assert row == {"a": "0", "a_1": "1", "a_1_1": "2", "列": "3", "列_1": "4", "a_2": "5"}


def test_history_of_many_batches_stays_small(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")

    def findings(run, n):
        return spark.createDataFrame([(f"s{i % 3}", f"{run}-{i}") for i in range(n)], "sheet_id string, code string").coalesce(1)

    def seen():
        return sorted((r.run_id, r.sheet_id, r.code) for r in src.read_history(spark, path).collect())

    want = {}

    def append(run, n, tag=""):
        src.append_history(findings(f"{run}{tag}", n), path, run)
        want[run] = [(run, f"s{i % 3}", f"{run}{tag}-{i}") for i in range(n)]
        assert seen() == sorted(x for rows in want.values() for x in rows)

    for k in range(6):
        append(f"{k:03d}", 4)
    src.compact_history(spark, path)
    append("006", 2)
    append("002", 3, "again")  # a replayed batch replaces what was compacted
    append("004", 0)  # and may find nothing
    before = seen()
    monkeypatch.setattr(src, "_delete", lambda spark, name: None)  # the job ends before it deletes
    src.compact_history(spark, path)
    assert seen() == before
    monkeypatch.undo()
    for k in range(7, 9):
        append(f"{k:03d}", 1)
        src.compact_history(spark, path)
        assert seen() == sorted(x for rows in want.values() for x in rows)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 3
    latest = {r.sheet_id: r.run_id for r in src.latest_history(src.read_history(spark, path)).collect()}
    assert latest == {"s0": "008", "s1": "002", "s2": "002"}


def test_names_are_told_apart_as_one_by_one(spark):
    import random
    from collections import Counter

    rng = random.Random(5)
    pieces = ["a", "a_1", "a_1_1", "a_2", "a_01", "b_1", "b", "x\n", "列_1", "", None, "a_1_1_1"]
    sheets = {f"s{i}": [rng.choice(pieces) for _ in range(rng.randint(1, 40))] for i in range(30)}
    rows = [(s, i, h) for s, hs in sheets.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "sheet_id string, col_no int, header string")
    for cut in (True, False):
        got = {(r.sheet_id, r.col_no): r["column"] for r in rs.dedupe_headers(df, cut).collect()}
        assert len(got) == len(rows)
        for s, hs in sheets.items():
            names = [(h or "").strip() or "列" for h in hs]
            for _ in range(2):
                seen = Counter()
                for i, n in enumerate(names):
                    names[i] = f"{n}_{seen[n]}" if seen[n] else n
                    seen[n] += 1
            taken = []
            for n in names:
                if n in taken:
                    n = next(f"{n}_{k}" for k in range(1, len(taken) + 2) if f"{n}_{k}" not in taken)
                taken.append(n)
            assert [got[s, i] for i in range(len(hs))] == taken


def test_a_wide_sheet_is_not_one_row(spark):
    # 60,000 columns in one row took minutes
    df = spark.range(60000).select(F.lit("s").alias("sheet_id"), F.col("id").alias("col_no"),
                                   F.when(F.col("id") % 3 == 0, "w").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("header"))
    plan = rs.dedupe_headers(df)
    assert plan.select("column").distinct().count() == 60000
    assert "collect_list" not in plan._jdf.queryExecution().executedPlan().toString()

"""Dependencies and other evidence."""

from pyspark.sql import functions as F

from sheetloom.operators import evidence as ev


def test_relation_kinds(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", 1), (1, "a", "y", 1), (2, "b", "x", 1), (3, "b", "z", None)],
        "k int, name string, part string, n int")
    assert ev.relation_kind(df, "k", "name").first().relation == "N:1"
    assert ev.relation_kind(df, "name", "k").first().relation == "1:N"
    assert ev.relation_kind(df, "k", "part").first().relation == "N:M"
    assert not ev.bijection(df, "k", "name").first().one_to_one
    got = {r.dependent: (r.groups, r.violating_groups) for r in
           ev.functional_dependency(df, "k", ["name", "part", "n"]).collect()}
    assert got == {"name": (3, 0), "part": (3, 1), "n": (3, 0)}


def test_grain(spark):
    lines = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "o int, p int")
    r = ev.key_grain(lines, "o", "p").first()
    assert (r.row_count, r.key_count, r.pair_count, r.grain) == (3, 2, 3, "key+detail")


def test_sequence(spark):
    df = spark.createDataFrame(
        [("w", "A", 1), ("w", "A", 1), ("w", "B", 2), ("v", "A", 1), ("v", "B", 1)],
        "w string, place string, seq int")
    got = {r.w: r.consistent for r in ev.sequence_consistency(df, "w", "place", "seq").collect()}
    assert got == {"w": True, "v": False}


def test_hot_key_is_exact(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") < 10000, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    r = ev.relation_kind(df, "k", "v").first()
    assert (r.max_b_per_a, r.max_a_per_b, r.relation) == (10000, 1, "1:N")


def test_units(spark):
    rows = [("体积", "体积(m³)"), ("体积", "体积(升)"), ("重量", "重量_吨"), ("重量", "重量 kg"), ("重量", "重量"),
            ("件数", "件数(kg)")]
    df = spark.createDataFrame([("s", *r) for r in rows], "sheet_id string, std_field string, column string")
    got = {r.column: r.reminder for r in ev.unit_reminders(df).collect()}
    assert got == {"体积(m³)": "ok", "体积(升)": "convert", "重量_吨": "convert", "重量 kg": "ok",
                   "重量": "unknown"}


def test_dates_and_zeroes(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "2024-01-03", 0, 0), ("2024-01-05", "2024-01-01", 0, 1), (None, "2024-01-01", 1, 1)],
        "a string, b string, v int, w int").withColumns(
        {"a": F.col("a").cast("date"), "b": F.col("b").cast("date")})
    r = ev.date_order(df, "a", "b").first()
    assert (r.pairs, r.ordered, r.in_gap) == (2, 1, 1)
    assert ev.co_zero(df, "v", "w").first().both_zero == 1
    assert ev.pattern_share(df.withColumn("s", F.lit("9.6m")), "s", r"^\d\.\dm$").first().share == 1.0


def test_relations_of_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    names = ["key", "name", "group", "free", "none", "one.two"]
    rows = [(s, i, f"n{i}", i % 4, rng.choice([None, 1.0, 2.0]), None, "c") for s in ("x", "y") for i in range(40)]
    df = spark.createDataFrame(rows, "s string, key int, name string, `group` int, free double, none string, `one.two` string")
    got = {(r.s, r.a, r.b): (r.max_b_per_a, r.max_a_per_b, r.relation) for r in ev.relation_matrix(df, names, "s").collect()}
    for s in ("x", "y"):
        for a, b in itertools.combinations(names, 2):
            if "none" in (a, b):
                assert (s, a, b) not in got
                continue
            one = ev.relation_kind(df.where(f"s = '{s}'"), a, b).first()
            assert got[s, a, b] == (one.max_b_per_a, one.max_a_per_b, one.relation), (a, b)


def test_relations_of_wide_columns(spark, monkeypatch):
    import random

    monkeypatch.setattr(ev, "FREQUENT", 0.02)
    rng = random.Random(4)
    names = ["key", "other", "few", "none"]
    rows = [(rng.choice(["x", "y", None]), 7 if i % 3 == 0 else i // 2, rng.choice([None, 5, rng.randint(0, 300)]), i % 4, None)
            for i in range(1500)]  # 7 and 5 are frequent
    df = spark.createDataFrame(rows, "s string, key int, other int, few int, none string")
    got = ev.relation_matrix(df, names, "s", wide=100)
    assert set(got.collect()) == set(ev.relation_matrix(df, names, "s", wide=10**9).collect()) and got.count() == 9
    for r in got.collect():
        one = ev.relation_kind(df.where(F.col("s").eqNullSafe(r.s)), r.a, r.b).first()
        assert (r.max_b_per_a, r.max_a_per_b, r.relation) == (one.max_b_per_a, one.max_a_per_b, one.relation)


def test_relations_of_wide_columns_travel_once(spark):
    df = spark.range(3000).selectExpr("id AS a", "id DIV 2 AS b", "id % 3 AS c")
    got = ev.relation_matrix(df, ["a", "b", "c"], wide=1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and {(r.a, r.b): r.relation for r in got.collect()} == {
        ("a", "b"): "N:1", ("a", "c"): "N:1", ("b", "c"): "N:M"}


def test_sequences_of_frequent_and_rare_groups(spark, monkeypatch):
    monkeypatch.setattr(ev, "FREQUENT", 0.02)
    rows = [(None if i % 5 == 0 else "hot" if i % 3 == 0 else f"g{i // 4}", i % 7, i % 2 if i % 11 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "w string, place int, seq int")
    got = {r.w: r for r in ev.sequence_consistency(df, "w", "place", "seq").collect()}
    want = {r.w: r for r in ev._fanouts(df, "place", "seq", "w").collect()}
    assert {w: tuple(r)[:3] for w, r in got.items()} == {w: tuple(r) for w, r in want.items()}


def test_tasks_of_sequences_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ev, "ROWS_PER_TASK", 500)
    df = spark.range(10000).selectExpr("id DIV 4 AS w", "id % 4 AS place", "id % 4 AS seq")
    plan = ev.sequence_consistency(df, "w", "place", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "21), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1

"""Hand-checked mapping cases and invariants of the assignment."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetloom.dictionary import ENGLISH, LOGISTICS
from sheetloom.operators import mapping as mp
from sheetloom.operators import matching as mt
from sheetloom.operators.classify import classify
from sheetloom.operators.profiling import profile_cells
from sheetloom.plans import onboarding

NAMES = LOGISTICS.names
M1 = {"s": {"订单编号": ["ORD001", "ORD002", "ORD003"],
            "发货日期": ["2024-01-01", "2024-01-02", "2024-01-03"],
            "运单号码": ["WB001", "WB001", "WB002"]}}


def as_mapping(spark, pairs, sheet="s"):
    rows = [(sheet, n, i, pairs.get(n)) for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "sheet_id string, std_field string, std_pos int, column string")


def as_dict(df):
    return {r.std_field: r.column for r in df.collect() if r.column is not None}


def test_rules_map_the_documented_sheet(cells):
    base = classify(profile_cells(cells(M1)))
    mapping = mt.assign_greedy(mt.rule_scores(base))
    found = {r.std_field: (r.column, round(r.score, 6)) for r in mapping.collect() if r.column}
    assert found == {"运输日期": ("发货日期", 1.0), "订单号": ("订单编号", 1.0),
                     "运单号": ("运单号码", 0.6)}
    confidence = mp.mapping_confidence(mapping).first()
    assert (confidence.coverage, confidence.confidence) == (0.2, 40.0)
    assert [r.code for r in mp.mapping_issues(mapping).collect()] == ["no_quantity"]


def test_similarity_of_order_names(spark):
    p = spark.createDataFrame([("s", "订单编号", 0)], "sheet_id string, column string, position int")
    score = mt.similarity_scores(p).where("std_field = '订单号'").first().score
    assert abs(score - 0.45) < 1e-9
    edit = mt.edit_similarity(p.withColumn("std_field", F.lit("订单号"))).first().edit_sim
    assert edit == 0.75


def test_similarity_fills_missing_fields_only(spark):
    p = spark.createDataFrame(
        [("s", "订单编号", 0), ("s", "订单号", 1)], "sheet_id string, column string, position int")
    mapping = as_mapping(spark, {"运单号": "订单号"}).withColumn(
        "stage", F.lit("x")).withColumn("score", F.lit(1.0))
    filled = as_dict(mt.fill_by_similarity(mapping, mt.similarity_scores(p)))
    assert filled == {"运单号": "订单号", "订单号": "订单编号"}


def test_character_similarity(spark):
    m = as_mapping(spark, {"订单号": "订单编号", "件数": "总件数", "体积": "xyz"})
    sims = {r.std_field: r.similarity for r in mp.name_similarity(m).collect()}
    assert sims == {"订单号": 0.75, "件数": 0.8, "体积": 0.0}
    assert [r.subject for r in mp.suspicious_mappings(m).collect()] == ["体积"]


def test_conflicts_keep_the_highest_index(spark):
    assert as_dict(mp.resolve_conflicts(as_mapping(spark, {"件数": "总量", "重量": "总量"}))) == {"重量": "总量"}
    # unlisted fields outrank listed ones
    assert as_dict(mp.resolve_conflicts(as_mapping(spark, {"承运商": "X", "件数": "X"}))) == {"承运商": "X"}
    # the first of two unlisted fields wins
    assert as_dict(mp.resolve_conflicts(as_mapping(spark, {"车型": "X", "路顺": "X"}))) == {"路顺": "X"}
    documented = LOGISTICS.with_priority(["订单号", "运单号", "运输日期", "件数", "体积", "重量"])
    assert as_dict(mp.resolve_conflicts(
        as_mapping(spark, {"件数": "总量", "重量": "总量"}), documented)) == {"件数": "总量"}


def test_empty_mapping_scores_ten(spark):
    m = as_mapping(spark, {})
    assert mp.mapping_confidence(m).first().confidence == 10.0
    codes = {r.code: r.detail for r in mp.mapping_issues(m).collect()}
    assert codes["missing_important"] == "运输日期, 订单号, 运单号"
    summary = mp.missing_summary(m).first()
    assert summary.missing_count == 15 and summary.all_missing


def test_route_without_waybill(spark):
    m = as_mapping(spark, {"路顺": "a", "件数": "b"})
    assert "route_without_waybill" in {r.code for r in mp.mapping_issues(m).collect()}


def test_duplicate_target_costs_thirty(spark):
    full = {n: f"{n}列" for n in NAMES}
    full["件数"] = full["体积"] = "件数体积"
    m = as_mapping(spark, full)
    findings = mp.mapping_check(m)
    assert {(r.severity, r.code) for r in findings.collect()} == {("error", "duplicate_target")}
    row = mp.mapping_score(findings, m).first()
    assert (row.errors, row.warnings, row.mapping_quality_score) == (1, 0, 70.0)


def test_keyword_fill_reuses_columns_and_reports_orphans(spark):
    p = spark.createDataFrame(
        [("s", "站点编号", 1), ("s", "客户名称", 0), ("s", "送货点", 2)],
        "sheet_id string, column string, position int")
    m = as_mapping(spark, {}).withColumn("stage", F.lit(None).cast("string")).withColumn(
        "score", F.lit(None).cast("double"))
    assert as_dict(mp.fill_by_keywords(m, p)) == {"发货方编号": "站点编号", "收货方名称": "客户名称"}
    assert mp.unknown_rule_fields() == ["收货方编号"]


def test_proposals_from_every_reply_form(spark):
    replies = {
        "nested": '好的 {"映射结果": {"订单号": "a", "重量": "missing"}} 完',
        "mapping": 'x {"mapping": {"件数": "b"}}',
        "bare": '```json\n{"订单号": "c"}\n```',
        "lines": '订单号：d\n件数: "e"\n重量: missing',
        "rating": '{"准确率": 80}\n订单号: f',
        "broken": '{"订单号": ',
        "none": "",
    }
    df = spark.createDataFrame(list(replies.items()), "sheet_id string, text string")
    got = {}
    for r in mp.parse_proposals(df).collect():
        if r.column:
            got.setdefault(r.sheet_id, {})[r.std_field] = r.column
    assert got == {"nested": {"订单号": "a"}, "mapping": {"件数": "b"}, "bare": {"订单号": "c"},
                   "lines": {"订单号": "d", "件数": "e"}, "rating": {"订单号": "f"}}
    assert mp.parse_proposals(df).count() == 15 * len(replies)


def test_mapping_object_needs_the_word(spark):
    df = spark.createDataFrame(
        [("a", 'Mapping: {"mapping": {"x": "y"}}'), ("b", '{"other": {"x": "y"}}')],
        "sheet_id string, text string")
    assert [tuple(r) for r in mp.extract_mapping_object(df).collect()] == [("a", "x", "y")]


def test_merge_prefers_the_first(spark):
    a, b = as_mapping(spark, {"件数": "p"}), as_mapping(spark, {"件数": "q", "重量": "r"})
    assert as_dict(mp.merge_proposals(a, b)) == {"件数": "p", "重量": "r"}


def test_render_is_ordered_json(spark):
    import json

    m = as_mapping(spark, {"件数": "n"})
    doc = json.loads(mp.render_mapping(m).first().document)
    assert list(doc["mapping"]) == NAMES
    assert doc["mapping"]["件数"] == "n" and doc["mapping"]["重量"] == "missing"
    assert doc["confidence"] == 20


def test_nfkc_forms_agree(spark):
    p = spark.createDataFrame(
        [("s", "Ｏｒｄｅｒ＿No.", 0), ("s", "体积 m³", 1), ("s", "A--b//c", 2)],
        "sheet_id string, column string, position int")
    fast = [r.norm_name for r in mt.normalize_names(p).orderBy("position").collect()]
    exact = [r.norm_name for r in mt.normalize_names(p, exact=True).orderBy("position").collect()]
    assert fast == exact == ["order no", "体积 m3", "a b c"]


def nested_loops(scores, n_fields, threshold, strict):
    """The plain sequential assignment, used as ground truth."""
    used, out = set(), {}
    for f in range(n_fields):
        best = None
        for (pos, col_pos), score in sorted(scores.items()):
            if pos == f and col_pos not in used and score > 0 and (best is None or score > best[1]):
                best = (col_pos, score)
        if best and (best[1] > threshold if strict else best[1] >= threshold):
            out[f] = best[0]
            used.add(best[0])
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from([0.0, 0.2, 0.3, 0.4, 0.7, 0.9]), min_size=20, max_size=20),
                min_size=15, max_size=15), st.booleans())
def test_assignment_equals_nested_loops(spark, grid, strict):
    rows = [("s", NAMES[f], f, f"c{c}", c, grid[f][c]) for f in range(15) for c in range(20)]
    df = spark.createDataFrame(
        rows, "sheet_id string, std_field string, std_pos int, column string, col_pos int, score double")
    got = {r.std_pos: int(r.column[1:]) for r in
           mt.assign_greedy(df, min_score=0.3, strict=strict).collect() if r.column}
    want = nested_loops({(f, c): grid[f][c] for f in range(15) for c in range(20)}, 15, 0.3, strict)
    assert got == want
    assert len(set(got.values())) == len(got)


def test_corpus_run_equals_single_runs(cells):
    other = {"t": {"总重量kg": [1.5, 2.5], "站点编号": ["a", "b"], "备注": [None, "x"]}}
    both = onboarding.map_fields(profile_cells(cells({**M1, **other}))).select(
        "sheet_id", "std_field", "column")
    single = onboarding.map_fields(profile_cells(cells(M1))).unionByName(
        onboarding.map_fields(profile_cells(cells(other)))).select("sheet_id", "std_field", "column")
    assert sorted(map(str, both.collect())) == sorted(map(str, single.collect()))


def test_onboard_repairs_headers_first(spark, cells):
    raw = cells({"s": {"Unnamed: 0": ["报表", "订单编号", "ORD1", "ORD2"],
                       "Unnamed: 1": [None, "总重量", "5", "6"]}})
    mapping, confidence = onboarding.onboard(raw)
    found = as_dict(mapping)
    assert found["订单号"] == "订单编号" and found["重量"] == "总重量"
    assert confidence.count() == 1


def test_prompts_hold_the_leading_rows(spark):
    df = spark.createDataFrame([("s", i, f"v{i}") for i in range(10)], "g string, i int, v string")
    row = mp.build_prompts(df, "g", "i", "D: {excel_data}", n=2).first()
    assert row.prompt == 'D: [{"i":0,"v":"v0"}, {"i":1,"v":"v1"}]' and row.sample_rows == 2


def test_assignment_with_repeated_names(spark):
    """Many columns of one name leave the next name to the next field."""
    fields = ENGLISH.fields[:2]
    rows = [("s", i, f.name, "a", pos, 0.9) for i, f in enumerate(fields) for pos in range(16)]
    rows += [("s", 1, fields[1].name, "b", 16, 0.5)]
    scores = spark.createDataFrame(
        rows, "sheet_id string, std_pos int, std_field string, column string, col_pos int, score double")
    got = {r.std_field: r.column for r in mt.assign_greedy(scores, ENGLISH).collect() if r.column}
    assert got == {fields[0].name: "a", fields[1].name: "b"}


def test_long_whole_numbers_are_int(spark):
    from pyspark.sql import functions as F

    from sheetloom.functions.exprs import text_kind

    df = spark.createDataFrame([("1234567890123456789",), ("20240101000000000001",), ("1.5",)], "t string")
    assert [r.k for r in df.select(text_kind(F.col("t")).alias("k")).collect()] == ["int", "int", "float"]


def test_compatibility_forms(spark):
    import unicodedata

    from sheetloom.functions.exprs import fold_width

    names = ["体积㎥", "重量㎏", "面积㎡", "①号", "Ⅱ型", "ＡＢＣ　１", "a½b³", "plain", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.f for r in df.select(fold_width(F.col("n")).alias("f")).collect()]
    assert got == [n and unicodedata.normalize("NFKC", n) for n in names]

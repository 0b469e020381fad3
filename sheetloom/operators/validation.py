"""Structure, content and rule checks; findings, scores, recommendations.

Findings are long rows (sheet_id, step, severity, subject, code, detail).
Checks aggregate before they emit, so a finding row is per sheet and subject,
never per offending data row unless the rule is about rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.dictionary import LOGISTICS, Dictionary
from sheetloom.functions.exprs import (
    as_list,
    clamp,
    count_true,
    half_up,
    inline_structs,
    is_missing,
    join_on,
    JSON_OPTIONS,
    json_keys,
    one_json_value,
    q,
    ratio,
)
from sheetloom.operators.mapping import FINDING_COLUMNS, mapping_check, mapping_score
from sheetloom.operators.profiling import kind_counts, kind_list
from sheetloom.plans.lineage import materialize

ENVELOPE_KEYS = ("filename", "total_rows", "columns", "data")
By = str | Sequence[str] | None


def _finding(step, severity, subject, code, detail) -> Column:
    return F.struct(
        F.lit(step).alias("step"), F.lit(severity).alias("severity"),
        subject.alias("subject"), F.lit(code).alias("code"), detail.alias("detail"),
    )


# ------------------------------------------------------------------ structure


def check_envelope(df: DataFrame, payload: str, sheet: str = "sheet_id") -> DataFrame:
    """Required keys, row-count type and list types of a JSON envelope.

    Type checks apply only when every required key is there.
    """
    base = df.select(F.col(sheet).alias("sheet_id"), one_json_value(F.col(payload)).alias("__p"))
    base = base.withColumn("__keys", json_keys(F.col("__p")))
    wanted = F.array(*[F.lit(k) for k in ENVELOPE_KEYS])
    gaps = F.array_except(wanted, F.coalesce("__keys", F.array().cast("array<string>")))
    # a value of another type reads as NULL
    document = F.from_json("__p", "total_rows bigint, columns array<string>, data array<string>", JSON_OPTIONS)
    base = base.withColumn("__v", document)
    bad_total = ~F.coalesce(F.col("__v.total_rows") >= 0, F.lit(False))
    complete = F.size(gaps) == 0

    def not_list(key: str) -> Column:
        return F.col(f"__v.{key}").isNull()

    missing = F.transform(
        gaps, lambda k: _finding("structure", "error", k, "missing_key", F.lit("absent"))
    )
    typed = F.array(
        *[
            F.when(
                complete & bad,
                _finding("structure", "error", F.lit(key), code, F.lit(note)),
            )
            for key, bad, code, note in (
                ("total_rows", bad_total, "bad_total_rows", "not a whole number"),
                ("columns", not_list("columns"), "not_a_list", "not a list"),
                ("data", not_list("data"), "not_a_list", "not a list"),
            )
        ]
    )
    out = base.select("sheet_id", F.explode(F.concat(missing, typed)).alias("__f"))
    return out.where(F.col("__f").isNotNull()).select("sheet_id", "__f.*")


def row_conformance(df: DataFrame, payload: str, expected: Sequence[str], row_id: str,
                    sheet: str = "sheet_id", label: str | None = "sheet") -> DataFrame:
    """Missing and extra keys of each JSON row; rows that are no object are errors.

    The source label column is never counted as extra.
    """
    want = F.array(*[F.lit(c) for c in expected])
    # read once, before the findings ask for it
    df = df.select(F.col(sheet).cast("string").alias("sheet_id"), F.col(row_id).cast("string").alias("__row"),
                   one_json_value(F.col(payload)).alias("__p"))
    df = df.withColumn("__keys", json_keys(F.col("__p")))
    keys = F.col("__keys")
    seen = F.coalesce(keys, F.array().cast("array<string>"))
    allowed = F.array(*[F.lit(c) for c in [*expected, *([label] if label else [])]])
    missing, extra = F.array_except(want, seen), F.array_except(seen, allowed)
    is_object = keys.isNotNull()  # NULL for any other value
    subject = F.col("__row")
    checks = F.array(
        F.when(~is_object, _finding("structure", "error", subject, "row_not_object",
                                    F.lit("not an object"))),
        F.when(is_object & (F.size(missing) > 0),
               _finding("structure", "warning", subject, "missing_columns",
                        F.array_join(F.array_sort(missing), ", "))),
        F.when(is_object & (F.size(extra) > 0),
               _finding("structure", "warning", subject, "extra_columns",
                        F.array_join(F.array_sort(extra), ", "))),
    )
    out = df.select("sheet_id", F.explode(checks).alias("__f"))
    return out.where(F.col("__f").isNotNull()).select("sheet_id", "__f.*")


def _marks(findings: DataFrame) -> DataFrame:
    return findings.groupBy("sheet_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("code") == "missing_key").alias("__absent"),
    )


def structure_score(findings: DataFrame, meta: DataFrame) -> DataFrame:
    """``100 - 20 errors - 5 warnings``; empty sheets 0, below ten rows x 0.8.

    ``meta`` has (sheet_id, total_rows).  A missing envelope key stops at 0.
    """
    joined = join_on(meta.select("sheet_id", "total_rows"), _marks(findings), ["sheet_id"], "left")
    filled = joined.select(
        "sheet_id", "total_rows",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings", "__absent")],
    )
    raw = F.lit(100.0) - F.col("errors") * 20 - F.col("warnings") * 5
    scaled = (
        F.when((F.col("__absent") > 0) | (F.col("total_rows") == 0), F.lit(0.0))
        .when(F.col("total_rows") < 10, raw * 0.8)
        .otherwise(raw)
    )
    return filled.withColumn("data_quality_score", clamp(scaled)).drop("__absent")


# -------------------------------------------------------------------- content


def high_null_warnings(profiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns emptier than the threshold."""
    rate = F.col("null_rate")
    return profiles.where(rate > threshold).select(
        "sheet_id", F.lit("content").alias("step"), F.lit("warning").alias("severity"),
        F.col("column").alias("subject"), F.lit("high_null_rate").alias("code"),
        _percent(rate).alias("detail"),
    )


def _percent(rate: Column) -> Column:
    return F.concat(F.format_string("%.2f", half_up(rate * 100, 2)), F.lit("%"))


def content_facts(cells: DataFrame, k: float = 3.0) -> DataFrame:
    """Everything the content checks need, in one aggregate per (sheet, column).

    Some value is further than ``k`` deviations from the mean exactly when the
    minimum or the maximum is, so no second pass over the rows is needed.
    """
    number = F.when(F.col("kind").isin("int", "float"), F.col("raw").try_cast("double"))
    blank = (F.col("kind") == "null") | (F.col("raw") == "")
    grouped = cells.groupBy("sheet_id", "column").agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_true(blank).alias("blanks"),
        *kind_counts(),
        F.count(number).alias("numbers"),
        F.min(number).alias("__lo"), F.max(number).alias("__hi"),
        F.avg(number).alias("__mean"), F.stddev_pop(number).alias("__std"),
    )
    limit = F.lit(float(k)) * F.col("__std")
    far = (F.col("__hi") - F.col("__mean") > limit) | (F.col("__mean") - F.col("__lo") > limit)
    return grouped.select(
        "sheet_id", "column", "total_rows",
        ratio(F.col("blanks"), F.col("total_rows")).alias("null_rate"),
        kind_list().alias("kinds"), "numbers", F.coalesce(far, F.lit(False)).alias("has_outliers"),
    )


def content_check(cells: DataFrame, sheets: DataFrame | None = None, k: float = 3.0,
                  threshold: float = 0.5) -> DataFrame:
    """Null rates, mixed kinds and outliers as findings.

    ``sheets`` lists all sheet ids; those without any cell get the empty error.
    """
    return findings_from_facts(content_facts(cells, k), sheets, threshold)


def findings_from_facts(facts: DataFrame, sheets: DataFrame | None = None,
                        threshold: float = 0.5) -> DataFrame:
    checks = F.array(
        F.when(F.col("null_rate") > threshold,
               _finding("content", "warning", F.col("column"), "high_null_rate",
                        _percent(F.col("null_rate")))),
        F.when(F.size("kinds") > 1,
               _finding("content", "warning", F.col("column"), "mixed_types",
                        F.array_join("kinds", ", "))),
        F.when(F.col("has_outliers"),
               _finding("content", "warning", F.col("column"), "outliers",
                        F.lit("beyond 3 sigma"))),
    )
    found = facts.select("sheet_id", F.explode(checks).alias("__f")).where(
        F.col("__f").isNotNull()
    ).select("sheet_id", "__f.*")
    if sheets is None:
        return found
    have = facts.select("sheet_id").distinct()
    empty = join_on(sheets.select("sheet_id"), have, ["sheet_id"], "left_anti")
    return found.unionByName(
        empty.select(
            "sheet_id",
            F.inline(F.array(_finding("content", "error", F.lit("data"), "no_data",
                                      F.lit("nothing to validate")))),
        )
    )


def content_score(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(100 - 25 errors - 8 warnings) * (1 - mean null rate)``, 0..100."""
    rates = profiles.groupBy("sheet_id").agg(F.avg("null_rate").alias("avg_null_rate"))
    joined = join_on(rates, _marks(findings).drop("__absent"), ["sheet_id"], "left").select(
        "sheet_id", "avg_null_rate",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings")],
    )
    raw = F.lit(100.0) - F.col("errors") * 25 - F.col("warnings") * 8
    return joined.withColumn("content_quality_score", clamp(raw * (1 - F.col("avg_null_rate"))))


# ------------------------------------------------------------- declared rules


def _rule_counts(df: DataFrame, by: By, sheet: str,
                 rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One aggregate for all rules; a finding row per violated rule and group."""
    keys = as_list(by)
    wide = df.groupBy(*[q(x) for x in keys]).agg(
        F.count(F.lit(1)).alias("__n"),
        *[count_true(bad).alias(f"__{i}") for i, (_, _, bad) in enumerate(rules)],
    )
    rows = [
        F.struct(F.lit(subject).alias("subject"), F.lit(code).alias("code"),
                 F.col(f"__{i}").alias("violations"))
        for i, (subject, code, _) in enumerate(rules)
    ]
    name = q(keys[0]).cast("string") if keys else F.lit(sheet)
    long = wide.select(name.alias("sheet_id"), F.col("__n"), inline_structs(rows))
    return long.where(F.col("violations") > 0).select(
        "sheet_id", F.lit("rules").alias("step"), F.lit("error").alias("severity"),
        "subject", "code", F.col("violations").cast("string").alias("detail"),
    )


def rule_required(df: DataFrame, cols: Sequence[str], by: str | None = None,
                  sheet: str = "sheet", nulls: str = "blank") -> DataFrame:
    """Required columns are there and filled; an absent column misses every row."""
    rules = [
        (c, "required", is_missing(q(c), df.schema[c].dataType, nulls)
         if c in df.columns else F.lit(True))
        for c in cols
    ]
    return _rule_counts(df, by, sheet, rules)


_TARGETS = {"numeric": "double", "date": "date", "integer": "bigint", "timestamp": "timestamp"}


def rule_types(df: DataFrame, types: Mapping[str, str], by: str | None = None,
               sheet: str = "sheet") -> DataFrame:
    """Values parse as the declared type (numeric, integer, date, timestamp)."""
    rules = []
    for c, kind in types.items():
        text = q(c).cast("string")
        rules.append((c, f"not_{kind}",
                      text.isNotNull() & (text != "")
                      & text.try_cast(_TARGETS[kind]).isNull()))
    return _rule_counts(df, by, sheet, rules)


def rule_range(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]],
               by: str | None = None, sheet: str = "sheet") -> DataFrame:
    """Numbers stay within the inclusive limits; an open side is None."""
    rules = []
    for c, (low, high) in ranges.items():
        value = q(c).try_cast("double")
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < F.lit(float(low)))
        if high is not None:
            bad = bad | (value > F.lit(float(high)))
        rules.append((c, "out_of_range", bad))
    return _rule_counts(df, by, sheet, rules)


def rule_pattern(df: DataFrame, patterns: Mapping[str, str], by: str | None = None,
                 sheet: str = "sheet") -> DataFrame:
    """Texts match the pattern from start (anchor it for a full match)."""
    rules = [(c, "pattern", ~q(c).cast("string").rlike(p)) for c, p in patterns.items()]
    return _rule_counts(df, by, sheet, rules)


def rule_custom(df: DataFrame, predicates: Mapping[str, str | Column], by: str | None = None,
                sheet: str = "sheet") -> DataFrame:
    """Named SQL predicates that every row must satisfy (NULL does not)."""
    rules = []
    for name, pred in predicates.items():
        ok = F.expr(pred) if isinstance(pred, str) else pred
        rules.append((name, "custom", ~F.coalesce(ok, F.lit(False))))
    return _rule_counts(df, by, sheet, rules)


# -------------------------------------------------------------------- bringing together

STEP_ADVICE = {
    "structure": "数据结构验证失败，请检查数据格式",
    "mapping": "字段映射验证失败，请检查映射关系",
    "content": "数据内容验证失败，请检查数据质量",
}


def step_results(scores: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (sheet, step): validity, counts, score, advice.

    ``scores`` maps a step to (sheet_id, errors, warnings, score); a step is
    valid without errors.
    """
    parts = [
        d.select("sheet_id", F.lit(step).alias("step"), "errors", "warnings",
                 F.col("score").cast("double").alias("score"))
        for step, d in scores.items()
    ]
    advice = F.create_map(*[x for k, v in STEP_ADVICE.items() for x in (F.lit(k), F.lit(v))])
    return reduce(DataFrame.unionByName, parts).select(
        "sheet_id", "step", (F.col("errors") == 0).alias("is_valid"), "errors", "warnings", "score",
        F.when(F.col("errors") > 0, F.element_at(advice, F.col("step"))).alias("recommendation"),
    )


def validate_all(cells: DataFrame, meta: DataFrame, mapping: DataFrame | None = None,
                 structure: DataFrame | None = None, dictionary: Dictionary = LOGISTICS,
                 cut: bool = True) -> tuple[DataFrame, DataFrame]:
    """Structure, mapping (when given) and content steps.

    ``meta`` has (sheet_id, total_rows); ``structure`` holds findings of
    ``check_envelope`` / ``row_conformance``.  Returns (findings, step results).
    Both need the content facts and the mapping, which hold one row per column
    or field, so these are written once (``cut``) and the cells read once.
    """
    facts = content_facts(cells)
    if cut:
        facts = materialize(facts)
        mapping = materialize(mapping) if mapping is not None else None
    content = findings_from_facts(facts, meta)
    findings = content.select(*FINDING_COLUMNS)
    if structure is not None:
        findings = findings.unionByName(structure.select(*FINDING_COLUMNS))
    shape = structure if structure is not None else content.where(F.lit(False))

    rated = content_score(content, facts).drop("errors", "warnings")
    marks = _marks(content)
    whole = join_on(join_on(meta.select("sheet_id"), rated, ["sheet_id"], "left"),
                    marks, ["sheet_id"], "left")
    scores = {
        "structure": structure_score(shape, meta).withColumnRenamed("data_quality_score", "score"),
        "content": whole.select(
            "sheet_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("errors", "warnings")],
            F.coalesce("content_quality_score", F.lit(0.0)).alias("score"),
        ),
    }
    if mapping is not None:
        checked = mapping_check(mapping, dictionary)
        findings = findings.unionByName(checked)
        scores["mapping"] = mapping_score(checked, mapping, dictionary).withColumnRenamed(
            "mapping_quality_score", "score"
        )
    return findings, step_results(scores)


def validation_summary(steps: DataFrame) -> DataFrame:
    """Steps passed and failed, scores by step, totals and overall status."""
    grouped = steps.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if("is_valid").alias("passed_steps"),
        F.count_if(~F.col("is_valid")).alias("failed_steps"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "score")))).alias(
            "quality_scores"
        ),
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warning_count"),
    )
    return grouped.withColumn(
        "overall_status", F.when(F.col("failed_steps") == 0, "通过").otherwise("失败")
    )


Check = Callable[[], DataFrame]


def run_checks(checks: Mapping[str, Check], names: Sequence[str], spark) -> DataFrame:
    """Findings of the named checks; an unknown name becomes an error finding."""
    parts = []
    for name in names:
        if name in checks:
            parts.append(checks[name]().select(F.lit(name).alias("check"), *FINDING_COLUMNS))
        else:
            row = [(name, None, "dispatch", "error", name, "unknown_check", "no such check")]
            schema = "check string, " + ", ".join(f"{c} string" for c in FINDING_COLUMNS)
            parts.append(spark.createDataFrame(row, schema))
    return reduce(DataFrame.unionByName, parts)


# -------------------------------------------------------------------- reporting


def recommendations(metrics: DataFrame, overall: DataFrame, consistency: DataFrame) -> DataFrame:
    """Advice rows per sheet; a single ``good`` row when nothing stands out.

    ``metrics``: sheet_id, column, null_percentage, unique_percentage;
    ``overall``: sheet_id, overall; ``consistency``: sheet_id, column,
    overall_consistency.
    """
    column_rules = F.array(
        F.when(F.col("null_percentage") > 50,
               F.struct(F.lit("high_null").alias("code"), F.col("null_percentage").alias("value"))),
        F.when(F.col("unique_percentage") < 5,
               F.struct(F.lit("low_unique").alias("code"),
                        F.col("unique_percentage").alias("value"))),
    )
    per_column = metrics.select("sheet_id", F.col("column").alias("subject"),
                                F.explode(column_rules).alias("__r"))
    per_column = per_column.where(F.col("__r").isNotNull()).select("sheet_id", "subject", "__r.*")
    low_total = overall.where(F.col("overall") < 80).select(
        "sheet_id", F.lit("sheet").alias("subject"), F.lit("low_completeness").alias("code"),
        F.col("overall").alias("value"),
    )
    uneven = consistency.where(F.col("overall_consistency") < 0.7).select(
        "sheet_id", F.col("column").alias("subject"), F.lit("low_consistency").alias("code"),
        F.col("overall_consistency").alias("value"),
    )
    advice = per_column.unionByName(low_total).unionByName(uneven)
    # one flag row per sheet decides the default, without a second run of the rules
    flagged = advice.withColumn("real", F.lit(1)).unionByName(
        overall.select("sheet_id", F.lit("sheet").alias("subject"), F.lit("good").alias("code"),
                       F.lit(None).cast("double").alias("value"), F.lit(0).alias("real"))
    )
    real = flagged.groupBy("sheet_id").agg(F.max("real").alias("__any"))
    return join_on(flagged, real, ["sheet_id"]).where(
        F.col("real") == F.col("__any")
    ).select("sheet_id", "subject", "code", "value")


def traffic_lights(metrics: DataFrame) -> DataFrame:
    """``warning`` above 30 % nulls or below 10 % unique, else ``success``."""
    return metrics.select(
        "sheet_id", "column", "null_percentage", "unique_percentage",
        F.when(F.col("null_percentage") > 30, "warning").otherwise("success").alias("null_light"),
        F.when(F.col("unique_percentage") < 10, "warning").otherwise("success")
        .alias("unique_light"),
    )


GRADE_BANDS = ((90, "优秀"), (80, "良好"), (70, "一般"), (60, "较差"))
LOWEST_GRADE = "很差"


def quality_grade(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``grade`` by score band."""
    expr = F
    for floor, label in GRADE_BANDS:
        expr = expr.when(F.col(score) >= floor, label)
    return scores.withColumn("grade", expr.otherwise(LOWEST_GRADE))


def composite_score(scores: DataFrame, dimensions: Sequence[str] = (
        "completeness", "consistency", "accuracy", "mapping")) -> DataFrame:
    """Four dimensions in 0..1, 25 points each."""
    total = reduce(lambda a, b: a + b, [F.col(d) * 25 for d in dimensions])
    return scores.withColumn("composite", total)

"""Mappings as long tables: fill, merge, parse, resolve, judge, render.

A mapping holds one row per (sheet, standard field); a NULL column means the
field is missing.  Groups per sheet are therefore bounded by the dictionary.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.dictionary import LOGISTICS, UNLISTED_PRIORITY, Dictionary
from sheetloom.functions.exprs import (
    clamp,
    contains_any,
    half_up,
    inline_structs,
    join_on,
    JSON_OPTIONS,
    ident,
    json_object,
    last_wins,
    one_json_value,
    ratio,
    strip,
)

FINDING_COLUMNS = ("sheet_id", "step", "severity", "subject", "code", "detail")


def _mapped() -> Column:
    return F.col("column").isNotNull()


def _flag(std: Column, names: list[str]) -> Column:
    return std.isin(*names) if names else F.lit(False)


# ------------------------------------------------------------------- filling


def keyword_hits(profiles: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """(sheet, std field, column) where the name contains a keyword of the field.

    Case-sensitive on the original name; an inline over the bounded rule list.
    """
    rows = [
        F.struct(
            F.lit(f.name).alias("std_field"),
            F.lit(i).alias("std_pos"),
            contains_any(F.col("column"), f.keywords).alias("hit"),
        )
        for i, f in enumerate(dictionary.fields)
        if f.keywords
    ]
    long = profiles.select("sheet_id", "column", "position", inline_structs(rows))
    return long.where(F.col("hit")).drop("hit")


def fill_by_keywords(mapping: DataFrame, profiles: DataFrame,
                     dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Missing fields take the first column (by position) with a keyword hit.

    A column may serve several fields here; conflicts are resolved later.
    """
    first = keyword_hits(profiles, dictionary).groupBy("sheet_id", "std_pos").agg(
        F.min_by("column", "position").alias("__first")
    )
    joined = join_on(mapping, first, ["sheet_id", "std_pos"], "left")
    filled = ~_mapped() & F.col("__first").isNotNull()
    return joined.select(
        "sheet_id", "std_field", "std_pos",
        F.coalesce("column", "__first").alias("column"),
        F.when(filled, F.lit("keywords")).otherwise(F.col("stage")).alias("stage"),
        "score",
    )


def unknown_rule_fields(dictionary: Dictionary = LOGISTICS) -> list[str]:
    """Keyword rules that name no standard field; they can never fire."""
    return sorted(dictionary.orphan_keywords)


def merge_proposals(first: DataFrame, second: DataFrame) -> DataFrame:
    """Field by field: the first proposal, else the second, else missing."""
    keys = ["sheet_id", "std_field", "std_pos"]
    a = first.select(*keys, F.col("column").alias("__a"))
    b = second.select(*keys, F.col("column").alias("__b"))
    joined = a.join(b, keys, "full")
    return joined.select(
        *keys,
        F.coalesce("__a", "__b").alias("column"),
        F.when(F.col("__a").isNotNull(), "proposal")
        .when(F.col("__b").isNotNull(), "rules").alias("stage"),
    )


# ------------------------------------------------------------------- parsing


# Fixed value: what may stand between a field's name and its column, and how the column is written.
TEXT_VALUE = r'[：:]\s*"?([^"\n]+)"?'


def _text_values(text: Column, dictionary: Dictionary) -> Column:
    """Per standard field the value after ``field:`` (either colon), quotes optional; NULL when absent.

    A pattern only runs where the field's name occurs at all.  One small expression does for all fields, so that it
    stays within what the JVM compiles.
    """
    fields = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(re.escape(f.name) + TEXT_VALUE).alias("pattern"))
                       for f in dictionary.fields])

    def value(field: Column) -> Column:
        found = strip(F.call_function("regexp_extract", text, field["pattern"], F.lit(1)))
        return F.when(F.contains(text, field["name"]), F.nullif(F.nullif(found, F.lit("")), F.lit("missing")))

    return F.transform(fields, value)


def parse_text_mapping(df: DataFrame, text: str = "text", sheet: str = "sheet_id",
                       dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """``field: value`` lines of a free-text reply, one row per standard field."""
    names = F.array(*[F.lit(n) for n in dictionary.names])
    # made once per reply, then laid out in rows
    made = df.select(F.col(sheet).alias("sheet_id"), _text_values(F.col(text), dictionary).alias("__v"))
    return made.select("sheet_id", F.posexplode("__v").alias("std_pos", "column")).select(
        "sheet_id", F.get(names, F.col("std_pos")).alias("std_field"), "std_pos", "column")


FENCE = "```"
NESTED_KEYS = ("映射结果", "mapping")
RATING_KEYS = ("confidence", "准确率")
_OBJECT = "map<string,string>"


def outer_braces(text: Column) -> Column:
    """The text from its first ``{`` to its last ``}``; NULL without both."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & F.contains(text, F.lit("}")) & (first < last), F.substring(text, first, last - first + 1))


def fenced_object(text: Column, tag: str) -> Column:
    """The first ``{...}`` that fills a fenced block opened with ``tag``; NULL without one."""
    pieces = F.split(text, FENCE)
    # what stands between two fences, whichever of them opens
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    tagged = F.filter(inner, lambda p: p.startswith(tag))
    bodies = F.transform(tagged, lambda p: strip(F.substring(p, F.lit(len(tag) + 1), F.length(p))))
    found = F.get(F.filter(bodies, lambda p: p.startswith("{") & p.endswith("}")), F.lit(0))
    return F.when(F.contains(text, F.lit(FENCE)), found)


def parse_proposals(df: DataFrame, text: str = "text", sheet: str = "sheet_id",
                    dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Mapping proposed in a reply: JSON body, fenced JSON, or text lines.

    The first body that is one JSON object and holds a nested mapping, standard fields or a
    rating decides; a rating alone, or no usable body, means the text lines.
    Standard fields without a value are missing.
    """
    staged = df.select(F.col(sheet).alias("sheet_id"), F.col(text).alias("__text"))
    staged = _decided(staged, dictionary)
    from_json = F.coalesce(F.col("__d.how") == "json", F.lit(False))
    texts = _text_values(F.col("__text"), dictionary)
    staged = staged.select("sheet_id", F.col("__d.m").alias("__m"), F.when(~from_json, texts).alias("__t"))
    names = F.array(*[F.lit(n) for n in dictionary.names])
    rows = staged.select("sheet_id", "__m", "__t", F.posexplode(names).alias("std_pos", "std_field"))
    value = F.try_element_at("__m", F.col("std_field"))
    value = F.when((value != "missing") & (value != ""), value)
    return rows.select("sheet_id", "std_field", "std_pos", F.when(F.col("__t").isNull(), value)
                       .otherwise(F.get("__t", F.col("std_pos"))).alias("column"))


def reply_kinds(df: DataFrame, text: str = "text", sheet: str = "sheet_id",
                dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """What each reply is for the mapping: ``none`` (NULL), ``empty`` (a nested mapping without entries) or ``mapping``."""
    staged = _decided(df.select(F.col(sheet).alias("sheet_id"), F.col(text).alias("__text")), dictionary)
    return staged.select("sheet_id", F.when(F.col("__text").isNull(), "none")
                         .when(F.size("__d.m") == 0, "empty").otherwise("mapping").alias("reply"))


def _decided(staged: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``__d``: how the reply of ``__text`` is read, and the mapping it holds as JSON."""
    staged = staged.withColumn("__d", F.lit(None).cast(f"struct<how:string,m:{_OBJECT}>"))
    known = F.array(*[F.lit(n) for n in dictionary.names])
    ratings = F.array(*[F.lit(k) for k in RATING_KEYS])
    nested_type = ", ".join(f"{ident(k)} {_OBJECT}" for k in NESTED_KEYS)
    for body in (outer_braces(F.col("__text")), fenced_object(F.col("__text"), "json"),
                 fenced_object(F.col("__text"), "")):
        # each body is read once, and only where no earlier one has decided
        staged = staged.withColumn("__b", one_json_value(F.when(F.col("__d").isNull(), body)))
        staged = staged.withColumn("__o", json_object(F.col("__b")))
        nested = F.from_json(F.when(F.arrays_overlap(F.map_keys("__o"), F.array(*[F.lit(k) for k in NESTED_KEYS])),
                                    F.col("__b")), nested_type, JSON_OPTIONS)
        staged = staged.withColumn("__n", nested)
        staged = staged.withColumn("__n", last_wins(F.coalesce(*[F.col("__n").getField(k) for k in NESTED_KEYS])))
        keys = F.map_keys("__o")
        decision = (
            F.when(F.col("__n").isNotNull(),
                   F.struct(F.lit("json").alias("how"), F.col("__n").alias("m")))
            .when(F.arrays_overlap(keys, known),
                  F.struct(F.lit("json").alias("how"), F.col("__o").alias("m")))
            .when(F.arrays_overlap(keys, ratings),
                  F.struct(F.lit("text").alias("how"), F.lit(None).cast(_OBJECT).alias("m")))
        )
        staged = staged.withColumn("__d", F.coalesce("__d", decision))
    return staged


def extract_mapping_object(df: DataFrame, text: str = "text", sheet: str = "sheet_id") -> DataFrame:
    """Entries of ``"mapping"`` between the first ``{`` and the last ``}``,
    only when the reply mentions a mapping at all."""
    asked = F.when(F.contains(F.lower(F.col(text)), F.lit("mapping")), outer_braces(F.col(text)))
    body = df.select(F.col(sheet).alias("sheet_id"), one_json_value(asked).alias("__b"))
    found = F.from_json("__b", f"mapping {_OBJECT}", JSON_OPTIONS).getField("mapping")
    return body.select("sheet_id", F.explode(last_wins(found)).alias("std_field", "column"))


# ------------------------------------------------------------------ conflicts


def mapping_conflicts(mapping: DataFrame) -> DataFrame:
    """Columns claimed by more than one standard field."""
    claims = mapping.where(_mapped()).groupBy("sheet_id", "column").agg(
        F.count(F.lit(1)).alias("claims"),
        F.array_sort(F.collect_list(F.struct("std_pos", "std_field"))).alias("__f"),
    )
    return claims.where(F.col("claims") > 1).select(
        "sheet_id", "column", "claims", F.col("__f.std_field").alias("std_fields")
    )


def _priority(dictionary: Dictionary) -> Column:
    pairs = [
        x
        for f in dictionary.fields
        for x in (F.lit(f.name),
                  F.lit(UNLISTED_PRIORITY if f.priority is None else f.priority))
    ]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), F.col("std_field")), F.lit(UNLISTED_PRIORITY)
    )


def resolve_conflicts(mapping: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Keeps one standard field per column, the others become missing.

    The highest priority index wins and unlisted fields outrank listed ones;
    pass ``dictionary.with_priority([...])`` for a first-listed-wins order.
    """
    order = W.partitionBy("sheet_id", "column").orderBy(F.desc("__p"), "std_pos")
    ranked = mapping.withColumn("__p", _priority(dictionary)).withColumn(
        "__r", F.row_number().over(order)
    )
    keep = _mapped() & (F.col("__r") == 1)
    plain = [c for c in mapping.columns if c not in ("column", "stage", "score")]
    extra = [c for c in ("stage", "score") if c in mapping.columns]
    return ranked.select(
        *plain,
        F.when(keep, F.col("column")).alias("column"),
        *[F.when(keep, F.col(c)).alias(c) for c in extra],
    )


# ------------------------------------------------------------------- judgement


def _findings(df: DataFrame, step: str, severity: str, subject: Column, code: str | Column,
              detail: Column) -> DataFrame:
    return df.select(
        "sheet_id", F.lit(step).alias("step"), F.lit(severity).alias("severity"),
        subject.alias("subject"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"), detail.alias("detail"),
    )


def _mapping_state(mapping: DataFrame, dictionary: Dictionary) -> DataFrame:
    """All per-sheet facts of a mapping in one aggregate of its few rows."""
    std = F.col("std_field")

    def mapped_among(names) -> Column:
        return F.count_if(_mapped() & _flag(std, list(names)))

    fields = dictionary.fields
    noted = _flag(std, [f.name for f in fields if f.required_note])
    return mapping.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if(_mapped()).alias("mapped_fields"),
        mapped_among(f.name for f in fields if f.important).alias("__important"),
        mapped_among(f.name for f in fields if f.other).alias("__other"),
        mapped_among([dictionary.route_field]).alias("__route"),
        mapped_among([dictionary.waybill_field]).alias("__waybill"),
        mapped_among(dictionary.quantity_fields).alias("__quantity"),
        F.array_sort(F.collect_list(
            F.when(~_mapped() & noted, F.struct("std_pos", "std_field"))
        )).alias("__missing"),
        F.array_sort(F.collect_list(
            F.struct(F.col("std_pos"), F.col("std_field"),
                     F.coalesce("column", F.lit("missing")).alias("column"))
        )).alias("__entries"),
    )


def _issue_array(dictionary: Dictionary) -> Column:
    def issue(bad: Column, code: str, detail: Column) -> Column:
        return F.when(bad, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    return F.array_compact(F.array(
        issue(F.size("__missing") > 0, "missing_important",
              F.array_join(F.col("__missing.std_field"), ", ")),
        issue(F.col("__quantity") == 0, "no_quantity",
              F.lit(", ".join(dictionary.quantity_fields))),
        issue((F.col("__route") > 0) & (F.col("__waybill") == 0), "route_without_waybill",
              F.lit(dictionary.route_field)),
    ))


def _confidence(dictionary: Dictionary) -> Column:
    important = float(sum(f.important for f in dictionary.fields))
    other = float(sum(f.other for f in dictionary.fields))
    score = (
        F.lit(0.6) * (F.col("__important").cast("double") / F.lit(important))
        + F.lit(0.3) * (F.col("__other").cast("double") / F.lit(other))
        + F.lit(0.1)
    )
    return half_up(score * 100, 1)


def mapping_issues(mapping: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Missing reported fields, route without waybill, no quantity field at all."""
    state = _mapping_state(mapping, dictionary)
    long = state.select("sheet_id", F.inline(_issue_array(dictionary)))
    return _findings(long, "mapping", "warning", F.lit("mapping"), F.col("code"), F.col("detail"))


def mapping_confidence(mapping: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """``.6 important + .3 other + .1`` in percent (1 dp), and coverage."""
    return _mapping_state(mapping, dictionary).select(
        "sheet_id", "total_fields", "mapped_fields",
        ratio(F.col("mapped_fields"), F.col("total_fields")).alias("coverage"),
        _confidence(dictionary).alias("confidence"),
    )


def render_mapping(mapping: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """One JSON document per sheet: mapping, analysis and integer confidence."""
    state = _mapping_state(mapping, dictionary).withColumn("__score", _confidence(dictionary))
    entries = F.map_from_entries(
        F.transform("__entries", lambda e: F.struct(e.std_field, e.column))
    )
    reminders = F.transform(
        _issue_array(dictionary), lambda i: F.concat_ws(": ", i.code, i.detail)
    )
    document = F.struct(
        entries.alias("mapping"),
        F.struct(
            F.col("mapped_fields"),
            reminders.alias("reminders"),
            F.concat(F.col("__score").cast("string"), F.lit("%")).alias("accuracy"),
        ).alias("analysis"),
        F.floor("__score").alias("confidence"),
    )
    return state.select("sheet_id", F.to_json(document).alias("document"))


def duplicate_targets(mapping: DataFrame) -> DataFrame:
    """Columns used for several standard fields, as errors."""
    counts = mapping.where(_mapped()).groupBy("sheet_id", "column").agg(
        F.count(F.lit(1)).alias("n")
    )
    return _findings(counts.where(F.col("n") > 1), "mapping", "error", F.col("column"),
                     "duplicate_target", F.col("n").cast("string"))


def unmapped_fields(mapping: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Standard fields without a column, as warnings.

    Compares standard fields with standard fields; a field that is absent from
    the mapping counts as missing.
    """
    have = mapping.groupBy("sheet_id").agg(
        F.collect_set(F.when(_mapped(), F.col("std_field"))).alias("__have")
    )
    wanted = F.array(*[F.lit(n) for n in dictionary.names])
    gaps = have.select("sheet_id", F.explode(F.array_except(wanted, "__have")).alias("std_field"))
    return _findings(gaps, "mapping", "warning", F.col("std_field"), "unmapped_field",
                     F.lit("missing"))


def _letters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def char_similarity(a: Column, b: Column) -> Column:
    """0.8 when one name contains the other, else character-set Jaccard."""
    a, b = F.lower(a), F.lower(b)
    x, y = _letters(a), _letters(b)
    union = F.size(F.array_union(x, y))
    return (
        F.when(F.contains(a, b) | F.contains(b, a), F.lit(0.8))
        .when(union == 0, F.lit(0.0))
        .otherwise(F.size(F.array_intersect(x, y)).cast("double") / union.cast("double"))
    )


def name_similarity(mapping: DataFrame) -> DataFrame:
    """Adds ``similarity`` between standard field and mapped column."""
    return mapping.where(_mapped()).withColumn(
        "similarity", char_similarity(F.col("std_field"), F.col("column"))
    )


def suspicious_mappings(mapping: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Mapped pairs whose names have little in common, as warnings."""
    low = name_similarity(mapping).where(F.col("similarity") < threshold)
    return _findings(low, "mapping", "warning", F.col("std_field"), "suspicious_mapping",
                     F.col("column"))


def mapping_check(mapping: DataFrame, dictionary: Dictionary = LOGISTICS,
                  threshold: float = 0.3) -> DataFrame:
    """The three mapping checks as one finding per sheet and code.

    A mapping has one row per standard field, so each sheet's rows fit in one
    small array and all checks share a single aggregate.
    """
    packed = mapping.groupBy("sheet_id").agg(
        F.collect_list(
            F.when(_mapped(), F.struct("std_field", F.col("column").alias("target")))
        ).alias("__m")
    )
    targets = F.col("__m.target")
    repeated = F.array_distinct(F.filter(
        targets, lambda t: F.size(F.filter(targets, lambda x: x == t)) > 1
    ))
    gaps = F.array_except(F.array(*[F.lit(n) for n in dictionary.names]), F.col("__m.std_field"))
    odd = F.transform(
        F.filter("__m", lambda m: char_similarity(m.std_field, m.target) < threshold),
        lambda m: m.std_field,
    )

    def finding(severity: str, code: str, subjects: Column) -> Column:
        return F.when(F.size(subjects) > 0, F.struct(
            F.lit("mapping").alias("step"), F.lit(severity).alias("severity"),
            F.lit("mapping").alias("subject"), F.lit(code).alias("code"),
            F.array_join(F.array_sort(subjects), ", ").alias("detail"),
        ))

    checks = F.array_compact(F.array(
        finding("error", "duplicate_target", repeated),
        finding("warning", "unmapped_field", gaps),
        finding("warning", "suspicious_mapping", odd),
    ))
    return packed.select("sheet_id", F.inline(checks))


def mapping_score(findings: DataFrame, mapping: DataFrame,
                  dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """``(100 - 30 errors - 10 warnings) * mapped / standard``, 0..100."""
    marks = findings.groupBy("sheet_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    mapped = mapping.groupBy("sheet_id").agg(F.count_if(_mapped()).alias("mapped_fields"))
    joined = join_on(mapped, marks, ["sheet_id"], "left").select(
        "sheet_id", "mapped_fields",
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
    )
    raw = F.lit(100.0) - F.col("errors") * 30 - F.col("warnings") * 10
    share = F.col("mapped_fields").cast("double") / F.lit(float(len(dictionary.fields)))
    return joined.withColumn("mapping_quality_score", clamp(raw * share))


def missing_summary(mapping: DataFrame) -> DataFrame:
    """Missing count, all-missing flag and one display line per field."""
    line = F.when(
        _mapped(), F.concat(F.lit("✅ "), F.col("std_field"), F.lit(" ← "), F.col("column"))
    ).otherwise(F.concat(F.lit("❌ "), F.col("std_field"), F.lit(" ← 未找到匹配")))
    grouped = mapping.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if(~_mapped()).alias("missing_count"),
        F.array_sort(F.collect_list(F.struct("std_pos", line.alias("line")))).alias("__l"),
    )
    return grouped.select(
        "sheet_id", "total_fields", "missing_count",
        (F.col("missing_count") == F.col("total_fields")).alias("all_missing"),
        F.array_join(F.col("__l.line"), "\n").alias("lines"),
    )


# --------------------------------------------------------------------- prompts


def build_prompts(df: DataFrame, by: str, order: str, template: str, n: int = 100,
                  slot: str = "{excel_data}") -> DataFrame:
    """Template filled with the first ``n`` rows of each sheet as JSON.

    Sampling the leading rows is the feature; the per-task limit keeps a huge
    sheet at ``n`` rows before anything is gathered.
    """
    from sheetloom.operators.reshape import cap_rows

    body = [c for c in df.columns if c != by]
    rows = cap_rows(df, by, order, n).select(
        F.col(by).alias("sheet_id"), F.col(order).alias("__o"),
        F.to_json(F.struct(*[F.col(c) for c in body])).alias("__row"),
    )
    packed = rows.groupBy("sheet_id").agg(
        F.array_sort(F.collect_list(F.struct("__o", "__row"))).alias("__rows"),
        F.count(F.lit(1)).alias("sample_rows"),
    )
    data = F.concat(F.lit("["), F.array_join(F.col("__rows.__row"), ", "), F.lit("]"))
    return packed.select(
        "sheet_id", "sample_rows",
        F.replace(F.lit(template), F.lit(slot), data).alias("prompt"),
    )

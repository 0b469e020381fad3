"""The data-quality report of a corpus of typed sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.exprs import join_on, q
from sheetloom.operators.classify import field_features
from sheetloom.operators.profiling import (
    basic_stats,
    completeness_columns,
    completeness_overall,
    completeness_rows,
    consistency,
    profile_columns,
    quality_metrics,
)
from sheetloom.operators.reshape import to_cells
from sheetloom.operators.validation import recommendations, traffic_lights
from sheetloom.plans.lineage import materialize


def quality_report(df: DataFrame, by: str, row_id: str, exact: bool = True,
                   cut: bool = True) -> dict[str, DataFrame]:
    """All report sections as DataFrames keyed by name.

    Sections that others build on hold one row per column or sheet and are
    written once (``cut``); the remaining ones are computed when used.
    """
    data = df.drop(row_id)
    keep = materialize if cut else (lambda section: section)

    def named(section: DataFrame) -> DataFrame:
        return section.withColumnRenamed(by, "sheet_id")

    metrics = keep(named(quality_metrics(data, by, exact)))
    overall = keep(named(completeness_overall(data, by)))
    even = keep(consistency(to_cells(df, row_id, by)))
    return {
        "basic_stats": named(basic_stats(data, by)),
        "quality_metrics": metrics,
        "field_analysis": field_features(
            profile_columns(data, by, nulls="strict", exact=exact)
        ),
        "completeness": overall,
        "completeness_rows": named(completeness_rows(data, by)),
        "completeness_columns": named(completeness_columns(data, by)),
        "consistency": even,
        "recommendations": recommendations(metrics, overall, even),
        "traffic_lights": traffic_lights(metrics),
    }


def nested_report(sections: dict[str, DataFrame]) -> DataFrame:
    """One row per sheet: the column sections as arrays, plus a timestamp.

    The arrays hold one entry per column of the sheet, never data rows.
    """
    out = sections["completeness"].withColumnRenamed("overall", "completeness")
    for name in ("quality_metrics", "field_analysis", "consistency", "recommendations"):
        part = sections[name]
        body = [q(c) for c in part.columns if c != "sheet_id"]
        packed = part.groupBy("sheet_id").agg(
            F.array_sort(F.collect_list(F.to_json(F.struct(*body)))).alias(name)
        )
        out = join_on(out, packed, ["sheet_id"], "left")
    rows = sections["completeness_rows"]
    stats = rows.select("sheet_id", F.struct("min", "max", "mean", "std").alias("row_stats"))
    return join_on(out, stats, ["sheet_id"], "left").withColumn(
        "timestamp", F.current_timestamp()
    )

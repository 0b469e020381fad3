"""Column classification from names and profiles; one projection each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom import dictionary as fixed
from sheetloom.functions.exprs import contains_any


def _lower_name() -> Column:
    return F.lower("column")


def category(name: Column, uniqueness: Column, data_type: Column) -> Column:
    return (
        F.when(contains_any(name, fixed.DATE_WORDS) | (data_type == "date"), "date")
        .when(contains_any(name, fixed.IDENTIFIER_WORDS) & (uniqueness > 0.8), "identifier")
        .when(contains_any(name, fixed.QUANTITY_WORDS) & (data_type == "numeric"), "quantity")
        .when(contains_any(name, fixed.NAME_WORDS), "name")
        .otherwise("unknown")
    )


def classify(profiles: DataFrame) -> DataFrame:
    """Adds ``category``: date, identifier, quantity, name or unknown."""
    return profiles.withColumn(
        "category", category(_lower_name(), F.col("uniqueness"), F.col("data_type"))
    )


def _field_type(name: Column) -> Column:
    return (
        F.when(contains_any(name, fixed.DATE_WORDS), "date")
        .when(contains_any(name, fixed.IDENTIFIER_WORDS), "identifier")
        .when(contains_any(name, fixed.QUANTITY_WORDS), "quantity")
        .when(contains_any(name, fixed.NAME_WORDS), "name")
        .when(contains_any(name, fixed.PRICE_WORDS), "price")
        .otherwise("unknown")
    )


def infer_field_type(profiles: DataFrame) -> DataFrame:
    """Adds ``inferred_type`` from the name alone."""
    return profiles.withColumn("inferred_type", _field_type(_lower_name()))


def _importance(name: Column) -> Column:
    def gain(cond: Column, weight: float) -> Column:
        return F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))

    parts = [gain(contains_any(name, words), w) for words, w in fixed.IMPORTANCE_WORDS]
    parts += [
        gain(F.col("null_rate") < 0.1, 0.1),
        gain(F.col("null_rate") < 0.5, 0.05),
        gain((F.col("uniqueness") > 0.1) & (F.col("uniqueness") < 0.9), 0.1),
    ]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def importance(profiles: DataFrame) -> DataFrame:
    """Adds ``importance_score`` (0..1) from name words and data shape."""
    return profiles.withColumn("importance_score", _importance(_lower_name()))


def _keywords(name: Column) -> Column:
    words = F.array(*[F.lit(w) for w in fixed.FEATURE_KEYWORDS])
    return F.filter(words, lambda w: F.contains(name, w))


def extract_keywords(profiles: DataFrame) -> DataFrame:
    """Adds ``keywords``: the listed words found in the name, list order kept."""
    return profiles.withColumn("keywords", _keywords(_lower_name()))


def field_features(profiles: DataFrame) -> DataFrame:
    """Inferred type, importance and keywords in one projection."""
    name = _lower_name()
    return profiles.select(
        "sheet_id", "column", "position",
        _field_type(name).alias("inferred_type"),
        _importance(name).alias("importance_score"),
        _keywords(name).alias("keywords"),
    )

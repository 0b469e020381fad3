"""Small Catalyst expressions: keys, missing values, rounding, name tests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("null", "int", "float", "bool", "text")


def as_list(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def data_columns(df: DataFrame, exclude: Iterable[str], columns: Sequence[str] | None) -> list[str]:
    skip = set(exclude)
    return list(columns) if columns is not None else [c for c in df.columns if c not in skip]


def q(name: str) -> Column:
    """Column by exact name, safe for dots and blanks in headers."""
    return F.col(ident(name))


def ident(name: str) -> str:
    """Quoted identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """Quoted string literal for SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, NULL when the denominator is zero."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def half_up(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any literal word occurs: one pattern of escaped alternatives."""
    if not words:
        return F.lit(False)
    return text.rlike("|".join(re.escape(w) for w in words))


def count_true(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_missing(col: Column, dtype: T.DataType, nulls: str = "blank") -> Column:
    """NULL test. ``blank`` also counts the empty string, ``strict`` does not."""
    if nulls not in ("blank", "strict"):
        raise ValueError(f"unknown null policy {nulls!r}")
    missing = col.isNull()
    if is_float(dtype):
        missing = missing | F.isnan(col)
    if nulls == "blank" and isinstance(dtype, T.StringType):
        missing = missing | (col == "")
    return missing


def schema_kind(dtype: T.DataType) -> str:
    """Runtime kind of the non-null cells of a typed column."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.NumericType):
        return "float"
    return "text"


INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"


def text_kind(raw: Column) -> Column:
    """Kind of a value that arrived as text (CSV and the like)."""
    return (
        F.when(raw.isNull(), "null")
        .when(raw.rlike(INT_PATTERN), "int")
        .when(raw.rlike(FLOAT_PATTERN) & raw.try_cast("double").isNotNull(), "float")
        .when(F.lower(raw).isin("true", "false"), "bool")
        .otherwise("text")
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Names in double quotes only; numbers may be NaN or infinite.
JSON_OPTIONS = {"allowSingleQuotes": "false"}


def one_json_value(text: Column) -> Column:
    """The text where it is exactly one JSON value, else NULL.

    The JSON parser stops after the first value, so the text is read as the first of two
    elements.  The second is a hash of the text: a tail would be a third element, would break
    the syntax, or would end the list before the hash.
    """

    def read(value: Column) -> Column:
        listed = F.concat(F.lit("["), value["text"], F.lit(","), value["mark"], F.lit("]"))
        return bound(F.from_json(listed, "array<string>", JSON_OPTIONS), lambda x: F.when(
            (F.size(x) == 2) & (F.get(x, F.lit(1)) == value["mark"]), value["text"]))

    return bound(text, lambda t: bound(F.struct(t.alias("text"), F.xxhash64(t).cast("string").alias("mark")), read))


def last_wins(entries: Column) -> Column:
    """A map whose repeated keys stay where they first come and have their last value."""

    def settled(m: Column) -> Column:
        backwards, names = F.reverse(F.map_entries(m)), F.array_distinct(F.map_keys(m))
        kept = F.transform(names, lambda k: F.struct(
            k.alias("key"), F.get(F.filter(backwards, lambda e: e["key"] == k), F.lit(0))["value"].alias("value")))
        return F.when(F.size(names) == F.size(m), m).otherwise(F.map_from_entries(kept))

    return bound(entries, settled)


def json_object(text: Column, values: str = "string") -> Column:
    """A JSON object as a map, the last of repeated keys kept; NULL for anything else.

    The text should be a single value (see ``one_json_value``).
    """
    return F.when(strip(text).startswith("{"), last_wins(F.from_json(text, f"map<string,{values}>", JSON_OPTIONS)))


def json_keys(text: Column) -> Column:
    """Keys of a JSON object in order; NULL for anything else.  The text should be a single value."""
    # the quick way knows no NaN
    return F.coalesce(F.json_object_keys(text), F.map_keys(json_object(text)))


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


def _compatible(first: int, last: int) -> dict[str, str]:
    """Characters with another compatibility form (NFKC), by rule."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(first, last + 1)}
    return {c: n for c, n in forms.items() if n != c}


_FORMS = _compatible(0xA0, 0xBF) | _compatible(0x2000, 0x33FF) | _compatible(0xFF01, 0xFFEE)
_SINGLE = {c: n for c, n in _FORMS.items() if len(n) == 1}
#: Units, numerals in circles, fractions and the like, which become several characters.
_SEVERAL = {c: n for c, n in _FORMS.items() if len(n) > 1}


def fold_width(text: Column) -> Column:
    """Compatibility forms (full width, powers, units, numerals) to plain ones, without leaving the JVM."""
    plain = F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values()))
    forms = F.create_map(*[F.lit(x) for kv in _SEVERAL.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(forms, c), c)), "")
    return F.when(plain.rlike("[" + "".join(_SEVERAL) + "]"), spelled).otherwise(plain)


def normalized_name(name: Column) -> Column:
    text = F.lower(fold_width(F.coalesce(name, F.lit(""))))
    text = F.regexp_replace(text, r"[_\-./\\]+", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_tokens(normalized: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(normalized, F.lit("([a-z0-9]+|[一-龥]+)"), F.lit(1))
    )


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in on))


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe keys, keeping the left copy of each key.

    No broadcast hint: the size of the right side grows with the number of
    sheets, so adaptive execution picks broadcast from the measured size and
    otherwise a shuffle join with skew splitting.
    """
    renamed = right.select(
        *[q(k).alias(f"__r_{k}") for k in on],
        *[q(c) for c in right.columns if c not in on],
    )
    cond = reduce(lambda a, b: a & b, (q(k).eqNullSafe(q(f"__r_{k}")) for k in on))
    joined = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__r_{k}" for k in on])


def inline_structs(structs: Sequence[Column]) -> Column:
    return F.inline(F.array(*structs))

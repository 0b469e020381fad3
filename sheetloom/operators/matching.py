"""Scoring columns against standard fields and assigning them one to one.

The dictionary is a bounded literal, so scoring is a projection that emits one
row per (column, standard field): no join, no broadcast, no shuffle.
Assignment is sequential over the standard fields.  It needs at most as many
candidates per field as there are fields (earlier fields can take no more
columns than that), so a ranked cut keeps the exact answer while one sheet's
state stays a small array however many columns it has.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.dictionary import (
    LOGISTICS,
    Alternative,
    Dictionary,
    StdField,
    literal_tokens,
    normalize_literal,
)
from sheetloom.functions.exprs import (
    contains_any,
    inline_structs,
    join_on,
    name_tokens,
    normalized_name,
)

# ------------------------------------------------------------------ rule score


def _hit(name: Column, alternative: Alternative) -> Column:
    cond = contains_any(name, alternative.groups[0])
    for group in alternative.groups[1:]:
        cond = cond & contains_any(name, group)
    return cond


def _term(name: Column, alternatives: tuple[Alternative, ...]) -> Column:
    expr = F
    for alt in alternatives:
        expr = expr.when(_hit(name, alt), F.lit(alt.weight))
    return expr.otherwise(F.lit(0.0))


def _condition(column: str, op: str, value, weight: float) -> Column:
    test = F.col(column) > F.lit(value) if op == ">" else F.col(column) == F.lit(value)
    return F.when(test, F.lit(weight)).otherwise(F.lit(0.0))


def _ordered_parts(field: StdField, name: Column) -> list[Column]:
    """Gains in the order they are added: name hit, profile, then further words."""
    terms = [_term(name, t) for t in field.terms]
    conditions = [_condition(*c) for c in field.conditions]
    if field.counts_totals:
        return [terms[0], *conditions, *terms[1:]]
    return [*terms, *conditions]


def _rule_score(field: StdField, name: Column) -> Column:
    score = F.lit(0.0)
    for part in _ordered_parts(field, name):
        score = score + part
    return score


def _per_field(profiles: DataFrame, dictionary: Dictionary, value, alias: str) -> DataFrame:
    rows = [
        F.struct(
            F.lit(f.name).alias("std_field"),
            F.lit(i).alias("std_pos"),
            value(f).alias(alias),
        )
        for i, f in enumerate(dictionary.fields)
    ]
    return profiles.select(
        "sheet_id", "column", F.col("position").alias("col_pos"), inline_structs(rows)
    )


def rule_scores(profiles: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Weighted keyword and profile score of every (column, standard field).

    ``profiles`` must carry ``category`` (see ``classify``).
    """
    prepared = profiles.withColumn("__low", F.lower("column"))
    return _per_field(
        prepared, dictionary, lambda f: _rule_score(f, F.col("__low")), "score"
    )


# ------------------------------------------------------------- name similarity


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Exact NFKC, Arrow batched; names only, never cell values."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_names(profiles: DataFrame, exact: bool = False) -> DataFrame:
    """Adds ``norm_name``: width-folded, lower case, separators to one blank.

    ``exact=True`` runs full NFKC in an Arrow UDF instead of the built-in fold.
    """
    source = nfkc(F.col("column")) if exact else F.col("column")
    return profiles.withColumn("norm_name", normalized_name(source))


def token_index(profiles: DataFrame) -> DataFrame:
    """(sheet, column, token) rows: Latin/digit runs and CJK runs of the name."""
    tokens = name_tokens(normalized_name(F.col("column")))
    return profiles.select("sheet_id", "column", F.explode(tokens).alias("token"))


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when((a == "") & (b == ""), F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double"))
    )


def edit_similarity(pairs: DataFrame, left: str = "column", right: str = "std_field") -> DataFrame:
    """Adds ``edit_sim`` between the normalised forms of two name columns."""
    return pairs.withColumn(
        "edit_sim", edit_ratio(normalized_name(F.col(left)), normalized_name(F.col(right)))
    )


def _overlap(tokens: Column, words: list[str]) -> Column:
    if not words:
        return F.lit(0.0)
    literal = F.array(*[F.lit(w) for w in words])
    shared = F.size(F.array_intersect(tokens, literal))
    union = F.size(tokens) + F.lit(len(words)) - shared
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(
        shared.cast("double") / union.cast("double")
    )


def token_overlap(profiles: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Token-set Jaccard of each (column, standard field); 0 if either is empty."""
    prepared = profiles.withColumn("__tokens", name_tokens(normalized_name(F.col("column"))))
    return _per_field(
        prepared, dictionary,
        lambda f: _overlap(F.col("__tokens"), literal_tokens(f.name)), "overlap",
    )


def _bonus(name: Column, field: StdField, dictionary: Dictionary) -> Column:
    bonus = F.lit(0.0)
    if field.unit_hints:
        bonus = bonus + F.when(contains_any(name, field.unit_hints), 0.2).otherwise(0.0)
    if field.counts_totals:
        bonus = bonus + F.when(contains_any(name, dictionary.total_hints), 0.2).otherwise(0.0)
    return F.least(F.lit(0.4), bonus)


def hint_bonus(profiles: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """Unit and total hints found in the name (0, 0.2 or 0.4)."""
    prepared = profiles.withColumn("__norm", normalized_name(F.col("column")))
    return _per_field(
        prepared, dictionary, lambda f: _bonus(F.col("__norm"), f, dictionary), "bonus"
    )


def similarity_scores(profiles: DataFrame, dictionary: Dictionary = LOGISTICS) -> DataFrame:
    """``.6 edit + .4 overlap + bonus`` for every (column, standard field)."""
    prepared = profiles.withColumn("__norm", normalized_name(F.col("column"))).withColumn(
        "__tokens", name_tokens(F.col("__norm"))
    )

    def blend(f: StdField) -> Column:
        edit = edit_ratio(F.col("__norm"), F.lit(normalize_literal(f.name)))
        overlap = _overlap(F.col("__tokens"), literal_tokens(f.name))
        return (F.lit(0.6) * edit + F.lit(0.4) * overlap) + _bonus(F.col("__norm"), f, dictionary)

    return _per_field(prepared, dictionary, blend, "score")


# ---------------------------------------------------------- ranking, assignment


def top_matches(scores: DataFrame, k: int = 1) -> DataFrame:
    """Best ``k`` columns per (sheet, standard field), first column wins ties."""
    order = W.partitionBy("sheet_id", "std_pos").orderBy(F.desc("score"), "col_pos")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


CHOSEN = "array<struct<std_pos:int,std_field:string,column:string,score:double>>"


def _fold(candidates: Column, min_score: float, strict: bool) -> Column:
    """Walks candidates sorted by (field, score desc, column) and takes each
    field's first acceptable column that no earlier field has taken."""

    def step(acc: Column, x: Column) -> Column:
        good = x.score > min_score if strict else x.score >= min_score
        free = ~F.exists(
            acc, lambda t: (t.std_pos == x.std_pos) | (t.column == x.column)
        )
        item = F.struct(
            x.std_pos.cast("int").alias("std_pos"),
            x.std_field.alias("std_field"),
            x.column.alias("column"),
            x.score.alias("score"),
        )
        return F.when(good & free, F.concat(acc, F.array(item))).otherwise(acc).cast(CHOSEN)

    return F.aggregate(candidates, F.array().cast(CHOSEN), step)


def _chosen_per_sheet(scores: DataFrame, n_fields: int, min_score: float, strict: bool) -> DataFrame:
    """One row per sheet with the array of accepted (field, column) pairs."""
    # columns are taken by name, so each name competes once, with its best score:
    # then at most as many names as earlier fields can be gone, and the cut is exact
    best = F.min_by(F.struct("score", "col_pos"), F.struct(-F.col("score"), "col_pos"))
    scores = scores.groupBy("sheet_id", "std_pos", "std_field", "column").agg(best.alias("__b")).select(
        "sheet_id", "std_pos", "std_field", "column", "__b.score", "__b.col_pos")
    order = W.partitionBy("sheet_id", "std_pos").orderBy(F.desc("score"), "col_pos")
    ranked = scores.withColumn("__rank", F.row_number().over(order)).where(
        F.col("__rank") <= n_fields
    )
    packed = ranked.groupBy("sheet_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("std_pos"), (-F.col("score")).alias("neg"), F.col("col_pos"),
                    F.col("std_field"), F.col("column"), F.col("score"),
                )
            )
        ).alias("__c")
    )
    return packed.select("sheet_id", _fold(F.col("__c"), min_score, strict).alias("__chosen"))


def _at_position(i: int):
    return lambda taken: taken.std_pos == i


def _spread_fields(per_sheet: DataFrame, dictionary: Dictionary, stage: str) -> DataFrame:
    """Every standard field of every sheet, missing ones with a NULL column."""
    rows = []
    for i, f in enumerate(dictionary.fields):
        mine = F.get(F.filter(F.col("__chosen"), _at_position(i)), 0)
        rows.append(
            F.struct(
                F.lit(f.name).alias("std_field"),
                F.lit(i).alias("std_pos"),
                mine["column"].alias("column"),
                F.when(mine["column"].isNotNull(), F.lit(stage)).alias("stage"),
                mine["score"].alias("score"),
            )
        )
    return per_sheet.select("sheet_id", inline_structs(rows))


def assign_greedy(scores: DataFrame, dictionary: Dictionary = LOGISTICS, min_score: float = 0.3,
                  strict: bool = True, stage: str = "rules") -> DataFrame:
    """Standard fields in order each take their best unused column.

    A column is accepted above ``min_score`` (at or above when not ``strict``).
    """
    chosen = _chosen_per_sheet(scores, len(dictionary.fields), min_score, strict)
    return _spread_fields(chosen, dictionary, stage)


def fill_by_similarity(mapping: DataFrame, sims: DataFrame, dictionary: Dictionary = LOGISTICS,
                       threshold: float = 0.4, only_missing: bool = True) -> DataFrame:
    """Gives still-missing fields their most similar unused column.

    Used columns and open fields of a sheet fit in one row (a mapping has one
    row per standard field), which is joined to the candidates once.
    """
    n = len(dictionary.fields)
    state = mapping.groupBy("sheet_id").agg(
        F.collect_set("column").alias("__used"),
        F.collect_set(F.when(F.col("column").isNull(), F.col("std_pos"))).alias("__open"),
    )
    free = join_on(sims, state, ["sheet_id"]).where(
        ~F.array_contains("__used", F.col("column")) & (F.col("score") > 0)
    )
    if only_missing:
        free = free.where(F.array_contains("__open", F.col("std_pos")))
    chosen = _chosen_per_sheet(
        free.drop("__used", "__open"), n, threshold, strict=False
    ).select("sheet_id", F.explode("__chosen").alias("__t")).select(
        "sheet_id", F.col("__t.std_pos").alias("std_pos"),
        F.col("__t.column").alias("__column"), F.col("__t.score").alias("__score"),
    )
    joined = join_on(mapping, chosen, ["sheet_id", "std_pos"], "left")
    found = F.col("__column").isNotNull()
    return joined.select(
        "sheet_id", "std_field", "std_pos",
        F.coalesce("__column", "column").alias("column"),
        F.when(found, F.lit("similarity")).otherwise(F.col("stage")).alias("stage"),
        F.when(found, F.col("__score")).otherwise(F.col("score")).alias("score"),
    )

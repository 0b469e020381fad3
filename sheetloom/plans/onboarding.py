"""From profiles to a mapping with confidence, for a corpus of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.dictionary import LOGISTICS, Dictionary
from sheetloom.functions.exprs import join_on
from sheetloom.operators.classify import classify
from sheetloom.operators.mapping import (
    fill_by_keywords,
    mapping_confidence,
    merge_proposals,
    parse_proposals,
    parse_text_mapping,
    reply_kinds,
    resolve_conflicts,
)
from sheetloom.operators.matching import (
    assign_greedy,
    fill_by_similarity,
    rule_scores,
    similarity_scores,
)
from sheetloom.operators.profiling import profile_cells
from sheetloom.operators.reshape import (
    column_tops,
    detect_header_row,
    drop_sparse,
    promote_header,
    unnamed_ratio,
)
from sheetloom.plans.lineage import materialize


def repair_headers(cells: DataFrame, threshold: float = 0.6, scan: int = 10) -> DataFrame:
    """Names for the columns of every sheet.

    Where headers are mostly unnamed, the header row among the first rows is promoted.  Where they are not, or no row
    fits, the headers that are there are trimmed, blank ones named and repeated ones numbered.  The cells are read
    twice: once for each column's header and first cells, once for the result.
    """
    columns = materialize(column_tops(cells, scan))
    headers = columns.select("sheet_id", "col_no", F.col("column").alias("header"))
    top = columns.select("sheet_id", "col_no", "column", F.inline("top"))
    broken = unnamed_ratio(headers, threshold).where("repair").select("sheet_id")
    rows = join_on(detect_header_row(top, scan), broken, ["sheet_id"], "left_semi")
    return promote_header(cells, rows, top=top, headers=headers)


def usable_profiles(profiles: DataFrame) -> DataFrame:
    """Sparse columns dropped (shipper words protected), categories added."""
    return classify(drop_sparse(profiles))


def map_fields(profiles: DataFrame, dictionary: Dictionary = LOGISTICS,
               replies: DataFrame | None = None, cut: bool = True) -> DataFrame:
    """Replies, rules, keywords, similarity and conflict resolution over profiles.

    ``replies`` (sheet_id, text) says per sheet what comes first:

    - a reply that proposes something (see ``parse_proposals``): its mapping alone, gaps filled by similarity;
    - a reply whose mapping is empty: its text lines, then rules, and no fill;
    - no reply (none, or NULL): rules, then keywords, gaps filled by similarity.

    Every stage reads the profiles again; they are tiny next to the data (one
    row per column), so they are written out once (``cut``) instead of letting
    each stage scan the data.
    """
    base = usable_profiles(profiles)
    if cut:
        base = materialize(base)
    rules = assign_greedy(rule_scores(base, dictionary), dictionary)
    if replies is None:
        mapping = fill_by_keywords(rules, base, dictionary)
        filled = None
    else:
        mapping, filled = _from_replies(rules, base, replies, dictionary, cut)
    if cut:
        mapping = materialize(mapping)
    similar = similarity_scores(base, dictionary)
    if filled is not None:
        similar = join_on(similar, filled, ["sheet_id"], "left_semi")
    return resolve_conflicts(fill_by_similarity(mapping, similar, dictionary), dictionary)


def _from_replies(rules: DataFrame, base: DataFrame, replies: DataFrame, dictionary: Dictionary,
                  cut: bool) -> tuple[DataFrame, DataFrame]:
    """The mapping before the fill, and the sheets that get one."""
    if cut:  # replies are read three times, and what they are made of should not be
        replies = materialize(replies)
    kinds = join_on(base.select("sheet_id").distinct(), reply_kinds(replies, dictionary=dictionary), ["sheet_id"], "left")
    kinds = kinds.withColumn("reply", F.coalesce("reply", F.lit("none")))
    if cut:
        rules, kinds = materialize(rules), materialize(kinds)

    def of(df: DataFrame, *wanted: str) -> DataFrame:
        return join_on(df, kinds.where(F.col("reply").isin(*wanted)).select("sheet_id"), ["sheet_id"], "left_semi")

    asked = of(replies, "mapping", "empty")
    score = F.lit(None).cast("double").alias("score")
    said = parse_proposals(of(asked, "mapping"), dictionary=dictionary).select(
        "sheet_id", "std_field", "std_pos", "column", F.when(F.col("column").isNotNull(), "proposal").alias("stage"), score)
    lines = parse_text_mapping(of(asked, "empty"), dictionary=dictionary)
    mixed = merge_proposals(lines, of(rules, "empty")).withColumn("score", F.lit(None).cast("double"))
    alone = fill_by_keywords(of(rules, "none"), of(base, "none"), dictionary)
    return said.unionByName(mixed).unionByName(alone), kinds.where("reply <> 'empty'").select("sheet_id")


def onboard(cells: DataFrame, dictionary: Dictionary = LOGISTICS,
            replies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells of raw sheets to (mapping, confidence)."""
    profiles = profile_cells(repair_headers(cells))
    mapping = map_fields(profiles, dictionary, replies)
    return mapping, mapping_confidence(mapping, dictionary)

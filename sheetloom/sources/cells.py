"""Raw cells of files and payloads whose columns differ.

A sheet is a file.  Its id is its path below the folder that was asked for, so that
equal names in two folders stay apart; names keep their blanks and letters.  Each
sheet has its own header: cells carry the name that their own file gives them.

Rows are numbered without moving them.  A file is read in blocks, and a block in one
task from its first line to its last, so a line's number is its place in the block
plus the lines of the blocks before: one small row per block, counted beforehand.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.functions.exprs import JSON_OPTIONS, as_list, bound, last_wins, one_json_value, q, strip, text_kind
from sheetloom.operators.reshape import BLANK_HEADER
from sheetloom.plans.lineage import materialize

#: A character that Unicode keeps out of texts; it stands for a separator outside quotes.
MARK = "﷐"
QUOTE = '"'
#: Kind of a cell by the type of its JSON value.
JSON_KINDS = {"VOID": "null", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "STRING": "text"}


def plain_path(path: Column) -> Column:
    """A file's path as it is written on disk: decoded, without scheme and host."""
    # a plus sign is itself in a path
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")


def _root(path: str | Sequence[str]) -> str:
    """The folder that sheet ids start below: the one common to all paths, before any wildcard."""
    plain = []
    for p in as_list(path):
        p = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/", p)
        p = p if p.startswith("/") else posixpath.abspath(p)
        fixed = re.split(r"[*?\[{]", p, maxsplit=1)
        plain.append(posixpath.normpath(p) if len(fixed) == 1 else posixpath.dirname(fixed[0]) or "/")
    return posixpath.commonpath(plain)


def sheet_path(path: str | Sequence[str]) -> Column:
    """Id of the sheet that a row of files under ``path`` comes from."""
    root, full = _root(path).rstrip("/"), plain_path(F.col("_metadata.file_path"))
    inside = F.substring(full, F.lit(len(root) + 2), F.length(full))
    name = F.element_at(F.split(full, "/"), -1)
    return F.when(full.startswith(root + "/"), inside).otherwise(name)


def split_line(line: Column, sep: str = ",") -> Column:
    """The values of a line: separators inside quotes belong to a value, doubled quotes are one.

    A line whose quotes don't come in pairs is cut at every separator.
    """
    def paired(pieces: Column) -> Column:
        # pieces with odd numbers stand inside quotes; an empty one between two of them is a doubled quote
        outside = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).when(
            (p == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit(QUOTE)).otherwise(F.replace(p, F.lit(sep), F.lit(MARK))))
        return F.when(F.size(pieces) % 2 == 1, F.split(F.array_join(outside, ""), MARK))

    quoted = F.when(F.contains(line, F.lit(QUOTE)), bound(F.split(line, QUOTE), paired))
    return F.coalesce(quoted, F.split(line, re.escape(sep)))


def _lines(spark: SparkSession, path: str | Sequence[str], options: dict[str, str]) -> DataFrame:
    """(sheet_id, block, mark, line) of all files; marks of a block's lines follow each other."""
    lines = spark.read.format("text").options(recursiveFileLookup="true", **options).load(path)
    return lines.select(sheet_path(path).alias("sheet_id"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("mark"), F.col("value").alias("line"))


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: its lines, those of the file before it, and the file's first line that isn't blank."""
    there = F.trim("line") != ""
    blocks = lines.groupBy("sheet_id", "block").agg(
        F.min("mark").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(there).alias("filled"),
        F.min(F.when(there, F.col("mark"))).alias("head_mark"), F.min_by("line", F.when(there, F.col("mark"))).alias("head"))
    before = W.partitionBy("sheet_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("sheet_id")
    placed = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    head = F.when(F.col("head_mark").isNotNull(),
                  F.struct((F.col("before") + F.col("head_mark") - F.col("first")).alias("at"), F.col("head").alias("line")))
    return placed.select("sheet_id", "block", "first", "n", "filled", "before", F.min(head).over(whole).alias("head"))


def _numbered(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with ``at``, their number in the file, and the file's ``head``."""
    place = F.col("mark") - F.col("first")
    # both passes read the same blocks in the same order, or the job ends
    sure = F.when((place >= 0) & (place < F.col("n")), place).otherwise(
        F.raise_error(F.lit("the files were cut into other blocks than when they were counted")).cast("long"))
    renamed = blocks.withColumnsRenamed({"sheet_id": "__s", "block": "__b"})
    joined = lines.join(renamed, (lines["sheet_id"] == renamed["__s"]) & (lines["block"] == renamed["__b"]), "left")
    return joined.select("sheet_id", (F.col("before") + sure).alias("at"), "line", "head")


def header_row(line: Column, sep: str) -> Column:
    """Names in a header line, blank ones as NULL."""
    bare = F.when(line.startswith("﻿"), F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    return F.transform(split_line(bare, sep), lambda x: F.nullif(F.trim(x), F.lit("")))


def _named(names: Column) -> Column:
    """Header names told apart: blank ones get a name, repeated ones a number."""
    full = F.transform(names, lambda n: F.coalesce(n, F.lit(BLANK_HEADER)))

    def numbered(n: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(full, F.lit(1), i), lambda x: F.lower(x) == F.lower(n)))
        return F.when(seen > 0, F.concat_ws("_", n, seen.cast("string"))).otherwise(n)

    return F.transform(full, numbered)


def csv_headers(spark: SparkSession, path: str | Sequence[str], sep: str = ",", **options: str) -> DataFrame:
    """(sheet_id, columns, row_count) of each CSV file that has a line: names told apart, rows that aren't blank."""
    blocks = _blocks(_lines(spark, path, options))
    files = blocks.groupBy("sheet_id").agg(F.min("head").alias("head"), (F.sum("filled") - 1).alias("row_count"))
    return files.where(F.col("head").isNotNull()).select(
        "sheet_id", _named(header_row(F.col("head.line"), sep)).alias("columns"), "row_count")


def csv_rows(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, sep: str = ",",
             **options: str) -> DataFrame:
    """Rows of CSV files (sheet_id and one text column per name), each value under the name that its file gives it.

    Without ``columns`` these are all names in the files, in the order they first come in; that takes a pass over the
    first lines.  Names are compared without regard to case.
    """
    lines = _lines(spark, path, options)
    blocks = materialize(_blocks(lines))
    if columns is None:
        heads = blocks.select("sheet_id", "head").where("head IS NOT NULL").distinct()
        names = heads.select("sheet_id", F.posexplode(_named(header_row(F.col("head.line"), sep))).alias("pos", "name"))
        first = names.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("sheet_id", "pos", "name")).alias("at"))
        # one row per column of the result
        columns = [r["name"] for r in first.orderBy("at").select("at.name").collect()]
    rows = _numbered(lines, blocks).where((F.col("at") > F.col("head.at")) & (F.trim("line") != ""))
    lower = F.transform(_named(header_row(F.col("head.line"), sep)), lambda n: F.lower(n))
    cut = rows.select("sheet_id", lower.alias("__names"), split_line(F.col("line"), sep).alias("__values"))

    def value(name: str) -> Column:
        place = F.array_position("__names", F.lit(name.lower())).cast("int")
        return F.nullif(F.get("__values", place - 1), F.lit("")).alias(name)

    return cut.select("sheet_id", *[value(c) for c in columns])


def json_keys_of_files(spark: SparkSession, path: str | Sequence[str], **options: str) -> DataFrame:
    """(sheet_id, columns, row_count) of files of JSON records: keys in the order they first come in."""
    lines = _lines(spark, path, options)
    records = lines.select("sheet_id", "block", "mark", F.map_keys(_record(F.col("line"))).alias("keys")).where(
        F.col("keys").isNotNull())
    counts = records.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("row_count"))
    keys = records.select("sheet_id", "block", "mark", F.posexplode("keys").alias("pos", "column"))
    # a block's marks follow each other, so block and mark order a file's records
    first = keys.groupBy("sheet_id", "column").agg(F.min(F.struct("block", "mark", "pos")).alias("at"))
    named = first.groupBy("sheet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "column"))),
                                                      lambda x: x["column"]).alias("columns"))
    return counts.join(named, "sheet_id", "left")


def read_cells(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", header: bool = True, sep: str = ",",
               **options: str) -> DataFrame:
    """Cells (sheet_id, row_no, col_no, column, raw, kind) of all files under ``path``.

    ``csv``: a line is a row.  With ``header`` the first line that isn't blank names the columns and rows count from
    the line after it; a cell beyond the names has none.  Without, every line is a row and no cell has a name.  A blank
    line is a row without cells.  An empty value is NULL; the kind of others follows their text.

    ``json``: a line is a record.  Columns are all keys of a file's records, in the order they first come in; a record
    without a key has a NULL cell.  Kinds follow the JSON values, nested values are kept as JSON text.  A line that
    is no JSON object is a row without cells.  ``json-list``: a file is one list of records, read by one task; a file
    that is no list has no rows.

    An empty file gives no cells.  ``options`` go to the reader of text files (``encoding``, ``pathGlobFilter``, ...).
    """
    if fmt == "json-list":
        texts = spark.read.format("text").options(recursiveFileLookup="true", wholetext="true", **options).load(path)
        lists = texts.select(sheet_path(path).alias("sheet_id"), one_json_value(F.col("value")).alias("__t"))
        each = lists.select("sheet_id", F.posexplode(_records(F.col("__t"))).alias("row_no", "__m"))
        return _record_cells(each.withColumn("row_no", F.col("row_no").cast("long")))
    lines = _lines(spark, path, options)
    if fmt == "json":
        rows = _numbered(lines, materialize(_blocks(lines)))
        return _record_cells(rows.select("sheet_id", F.col("at").alias("row_no"), _record(F.col("line")).alias("__m")))
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}, expected one of csv, json, json-list")
    rows = _numbered(lines, materialize(_blocks(lines)))
    names = F.array().cast("array<string>")
    if header:
        # the header is split in its row and not once for each cell
        rows = rows.where(F.col("at") > F.col("head.at")).withColumn("names", header_row(F.col("head.line"), sep))
        rows = rows.withColumn("row_no", F.col("at") - F.col("head.at") - 1)
        names = F.col("names")
    else:
        bare = F.when((F.col("at") == 0) & F.col("line").startswith("﻿"), F.expr("substring(line, 2)"))
        rows = rows.withColumn("line", F.coalesce(bare, "line")).withColumn("row_no", F.col("at"))
    values = F.when(F.trim("line") != "", split_line(F.col("line"), sep))
    cells = rows.select("sheet_id", "row_no", names.alias("names"), F.posexplode(values).alias("col_no", "raw"))
    raw = F.nullif("raw", F.lit(""))
    return cells.select("sheet_id", "row_no", "col_no", F.get("names", F.col("col_no")).alias("column"), raw.alias("raw"),
                        text_kind(raw).alias("kind"))


def _json_cell(value: Column) -> tuple[Column, Column]:
    """Text and kind of a JSON value."""
    kinds = F.create_map(*[F.lit(x) for kv in JSON_KINDS.items() for x in kv])
    name = F.schema_of_variant(value)
    kind = F.when(value.isNull(), "null").when(name.startswith("DECIMAL"), "float").otherwise(
        F.coalesce(F.try_element_at(kinds, name), F.lit("text")))
    return F.when(kind != "null", F.try_variant_get(value, "$", "string")), kind


def _record(text: Column) -> Column:
    return last_wins(F.from_json(text, "map<string,variant>", JSON_OPTIONS))


def _records(text: Column) -> Column:
    listed = F.from_json(F.when(strip(text).startswith("["), text), "array<map<string,variant>>", JSON_OPTIONS)
    return F.transform(listed, last_wins)


def _record_cells(records: DataFrame) -> DataFrame:
    """Cells of JSON records (sheet_id, row_no, __m)."""
    keys = records.select("sheet_id", "row_no", F.posexplode(F.map_keys("__m")).alias("pos", "column"))
    first = keys.groupBy("sheet_id", "column").agg(F.min(F.struct("row_no", "pos")).alias("at"))
    # one row per sheet: its columns in order
    names = materialize(first.groupBy(F.col("sheet_id").alias("__s")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "column"))), lambda x: x["column"]).alias("names")))
    joined = records.where(F.col("__m").isNotNull()).join(names, F.col("sheet_id") == F.col("__s"))
    cells = joined.select("sheet_id", "row_no", "__m", F.posexplode("names").alias("col_no", "column"))
    cells = cells.withColumn("__v", F.try_element_at("__m", F.col("column")))
    raw, kind = _json_cell(F.col("__v"))
    return cells.select("sheet_id", "row_no", "col_no", "column", raw.alias("raw"), kind.alias("kind"))


def payload_cells(df: DataFrame, payload: str = "payload", sheet: str = "sheet_id") -> DataFrame:
    """Cells of JSON payloads, whose columns may differ from row to row of ``df``; each row is a sheet.

    An object is ``column -> list``: entries that are no list are skipped and take no column number, lists shorter
    than the longest are padded with NULL cells, and of repeated keys the last counts.  A list holds records: the
    first one names the columns.  A payload that is NULL, broken or without columns gives no cells.
    """
    texts = df.select(q(sheet).cast("string").alias("sheet_id"), one_json_value(q(payload)).alias("__t"))
    parsed = texts.select("sheet_id", F.map_entries(_record(F.col("__t"))).alias("__o"), _records(F.col("__t")).alias("__r"))
    listed = F.transform("__o", lambda e: F.struct(
        e["key"].alias("column"), F.try_variant_get(e["value"], "$", "array<variant>").alias("values")))
    named = F.transform(F.map_keys(F.get("__r", F.lit(0))), lambda k: F.struct(
        k.alias("column"), F.transform("__r", lambda m: F.try_element_at(m, k)).alias("values")))
    columns = F.coalesce(F.filter(listed, lambda e: e["values"].isNotNull()), named)
    sheets = parsed.select("sheet_id", columns.alias("__l"))
    longest = F.aggregate("__l", F.lit(0), lambda n, e: F.greatest(n, F.size(e["values"])))
    spread = sheets.select("sheet_id", longest.alias("__n"), F.posexplode("__l").alias("col_no", "__c"))
    places = F.transform(F.sequence(F.lit(1), F.col("__n")), lambda i: F.get(F.col("__c.values"), i - 1))
    cells = spread.where("__n > 0").select("sheet_id", "col_no", F.col("__c.column").alias("column"),
                                           F.posexplode(places).alias("row_no", "__v"))
    raw, kind = _json_cell(F.col("__v"))
    return cells.select("sheet_id", F.col("row_no").cast("long").alias("row_no"), "col_no", "column", raw.alias("raw"),
                        kind.alias("kind"))

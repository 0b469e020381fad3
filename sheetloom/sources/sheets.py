"""Sheets in and results out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.exprs import as_list, ident, q
from sheetloom.sources.cells import csv_headers, csv_rows, json_keys_of_files, plain_path, sheet_path

FORMATS = ("json", "csv", "parquet", "orc")


def _reader(spark: SparkSession, fmt: str, schema, options: Mapping[str, str]):
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}, expected one of {FORMATS}")
    defaults = {"json": {"primitivesAsString": "false"}, "parquet": {"mergeSchema": "true"}, "orc": {"mergeSchema": "true"}}
    reader = spark.read.format(fmt).options(**{**defaults.get(fmt, {}), **options})
    return reader.schema(schema) if schema is not None else reader


def read_sheets(spark: SparkSession, path: str | Sequence[str], fmt: str = "json",
                schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Rows of all files under ``path`` with the file's path below it as ``sheet_id``.

    Values go to columns by name, whatever the order of a file's columns; a column that a file lacks is NULL there.
    JSON may be lines or (``multiLine="true"``) lists of records per file.  CSV values are texts, or what ``schema``
    says where their text reads as that; give a ``schema`` to spare the pass that finds the columns.
    """
    if fmt == "csv":
        if schema is None:
            return csv_rows(spark, path, **options)
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        rows = csv_rows(spark, path, fields.names, **options)
        return rows.select("sheet_id", *[q(f.name).try_cast(f.dataType).alias(f.name) for f in fields])
    df = _reader(spark, fmt, schema, {"recursiveFileLookup": "true", **options}).load(path)
    return df.select(sheet_path(path).alias("sheet_id"), "*")


def columnar_to_rows(df: DataFrame, cols: Sequence[str] | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """``column -> list`` payloads to rows; entries that are no list are skipped.

    Shorter lists are padded with NULL, ``row_no`` is the list position.
    """
    wanted = list(cols) if cols is not None else [c for c in df.columns if c not in keep]
    lists = [c for c in wanted if isinstance(df.schema[c].dataType, T.ArrayType)]
    zipped = F.arrays_zip(*[q(c) for c in lists])
    return df.select(*[q(k) for k in keep], F.posexplode(zipped).alias("row_no", "__r")).select(
        *[q(k) for k in keep], "row_no",
        *[F.col("__r").getField(c).alias(c) for c in lists],
    )


def _footers(listed: DataFrame, fmt: str) -> DataFrame:
    """(sheet_id, columns, row_count) of Parquet or ORC files (sheet_id, uri): tasks read the files' ends alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, orc, parquet

        for batch in batches:
            names, rows = [], []
            for uri in batch.column("uri").to_pylist():
                if uri.startswith("/"):
                    system, place = fs.LocalFileSystem(), uri
                else:
                    system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as file:
                    if fmt == "parquet":
                        end = parquet.ParquetFile(file)
                        names.append(end.schema_arrow.names)
                        rows.append(end.metadata.num_rows)
                    else:
                        end = orc.ORCFile(file)
                        names.append(end.schema.names)
                        rows.append(end.nrows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sheet_id"), pa.array(names, pa.list_(pa.string())), pa.array(rows, pa.int64())],
                names=["sheet_id", "columns", "row_count"])

    return listed.select("sheet_id", "uri").mapInArrow(run, "sheet_id string, columns array<string>, row_count long")


def file_inventory(spark: SparkSession, path: str, glob: str = "*", fmt: str = "parquet",
                   **options: str) -> DataFrame:
    """Name, id (path below ``path``), bytes, time, rows and own columns of every matching file.

    Sizes come from the listing, whose contents are pruned away.  Parquet and ORC files tell rows and columns in their
    footers; CSV files are counted, with the first line that isn't blank as header; JSON files are read for the keys
    of their records.  A file without any has no columns and zero rows; files of no bytes are not listed by Spark.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}, expected one of {FORMATS}")
    uri = F.col("_metadata.file_path")
    local = F.when(uri.startswith("file:"), plain_path(uri)).otherwise(uri)
    listed = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup="true").load(path).select(
        sheet_path(path).alias("sheet_id"), local.alias("uri"),
        F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modificationTime"))
    if fmt in ("parquet", "orc"):
        found = _footers(listed.where("bytes > 0"), fmt)
    elif fmt == "csv":
        found = csv_headers(spark, path, pathGlobFilter=glob, **options)
    else:
        found = json_keys_of_files(spark, path, pathGlobFilter=glob, **options)
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    return listed.join(found, "sheet_id", "left").select(
        F.element_at(F.split("sheet_id", "/"), -1).alias("file_name"), "sheet_id", "bytes", "modificationTime",
        F.coalesce("row_count", F.lit(0)).alias("row_count"), F.size(columns).alias("column_count"),
        columns.alias("columns"))


def union_sheets(sheets: Mapping[str, DataFrame], label: str = "sheet") -> DataFrame:
    """Sheets below each other: label column plus the sorted union of columns."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in sheets.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(label, *[q(c) for c in sorted(set(whole.columns) - {label})])


def write_json(df: DataFrame, path: str, by: str | Sequence[str] | None = None,
               mode: str = "overwrite", max_records: int = 1_000_000) -> None:
    """JSON lines, one directory per group; big groups roll over into more files."""
    keys = as_list(by)
    if keys:  # small groups share a task, large ones are split
        df = df.hint("rebalance", *[q(k) for k in keys])
    writer = df.write.mode(mode).option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*keys) if keys else writer).json(path)


HISTORY_KEYS = ("run_id",)


def append_history(findings: DataFrame, path: str, run_id: str) -> None:
    """Adds the findings of one run to the history.

    A run owns its partition and replaces it when repeated, so a retried batch
    never doubles its rows.
    """
    stamped = findings.withColumn("validated_at", F.current_timestamp())
    stamped.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


#: Findings of many runs in few files, one folder per generation; Spark's readers pass over names that begin so.
COMPACTED = "_compacted"


def _files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, full path) of what a folder holds; nothing if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return [(x.getPath().getName(), x.getPath().toString()) for x in system.listStatus(path)]


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _live_runs(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Data files of each run that has a folder of its own."""
    runs = {name[len("run_id="):]: full for name, full in _files(spark, path) if name.startswith("run_id=")}
    found = {run: [f for n, f in _files(spark, full) if n.endswith(".parquet")] for run, full in runs.items()}
    return {run: files for run, files in found.items() if files}


def _generations(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Complete generations, oldest first: those whose write has been committed."""
    found = [(int(name.split("=")[1]), full) for name, full in _files(spark, f"{path.rstrip('/')}/{COMPACTED}")
             if name.startswith("generation=")]
    return sorted(x for x in found if any(n == "_SUCCESS" for n, _ in _files(spark, x[1])))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs; ``run_id`` stays the text it was written as.

    A run with a folder of its own counts as that folder says, also where an older form of it was compacted.
    """
    live, generations = _live_runs(spark, path), _generations(spark, path)
    parts = []
    if generations:
        old = spark.read.parquet(generations[-1][1])
        parts.append(old.where(~F.col("run_id").isin(*live)) if live else old)
    if live or not parts:
        found = spark.read.option("mergeSchema", "false").parquet(path)
        columns = [f"{ident(f.name)} {f.dataType.simpleString()}" for f in found.schema if f.name != "run_id"]
        parts.append(spark.read.schema(", ".join([*columns, "run_id string"])).parquet(path))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compact_history(spark: SparkSession, path: str) -> None:
    """Puts the runs of a history together in a new generation of few files.

    What a reader sees never changes: the generation counts once its write is committed, and a run's own files, which
    say the same, are deleted after that.  A run that is written again at any time has files of other names, which
    stay and count.  The generation before stays for readers that are at work.
    """
    live, generations = _live_runs(spark, path), _generations(spark, path)
    if not live:
        return
    number = generations[-1][0] + 1 if generations else 0
    whole = read_history(spark, path).hint("rebalance")
    whole.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{COMPACTED}/generation={number:09d}")
    for files in live.values():
        for name in files:
            _delete(spark, name)
    for _, folder in generations[:-1]:
        _delete(spark, folder)


def latest_history(history: DataFrame) -> DataFrame:
    """Findings of the latest run of each sheet."""
    last = history.groupBy("sheet_id").agg(
        F.max_by("run_id", F.struct("validated_at", F.col("run_id").cast("string"))).alias("run_id")
    )
    return history.join(last, ["sheet_id", "run_id"], "left_semi")

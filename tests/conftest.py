import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cells(spark):
    """Builds cells from {sheet: {column: [values]}} of Python values."""

    def build(sheets):
        rows = []
        for sheet, columns in sheets.items():
            for col_no, (name, values) in enumerate(columns.items()):
                for row_no, v in enumerate(values):
                    kind = {type(None): "null", int: "int", float: "float", bool: "bool"}.get(
                        type(v), "text")
                    rows.append((sheet, row_no, col_no, name, None if v is None else str(v), kind))
        return spark.createDataFrame(
            rows, "sheet_id string, row_no long, col_no int, column string, raw string, kind string")

    return build

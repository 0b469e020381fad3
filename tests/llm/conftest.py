import pytest

from sheetloom.llm.base import ready


@pytest.fixture
def docs(spark):
    """Documents from {id: text} or (id, text) pairs, with extra columns under names the operators use inside."""
    ready(spark)

    def build(rows, **more):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        names = ["id", "size", "h", "words", "kind"]
        return spark.createDataFrame(
            [(i, t, *["x"] * len(names), *more.values()) for i, t in rows],
            "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
            + "".join(f", {k} string" for k in more))

    return build

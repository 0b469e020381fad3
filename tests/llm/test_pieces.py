"""Secrets beside signs of another alphabet."""

import pyarrow as pa

from sheetloom.llm import secrets


def test_runs_of_mixed_signs_are_tested_in_pieces():
    key = "9fQ2xLr7Vb0TzKp4HsYw1NcE"
    text = f"at prod_keys/{key} and my-bucket+{key}== end"
    _, (tried,) = secrets._kernel()(pa.array([text]))
    found = [text[t["start"]:t["end"]] for t in tried]
    assert key in found and f"bucket+{key}==" in found
    _, (plain,) = secrets._kernel()(pa.array([f"x {key} y"]))
    assert [(t["start"], t["end"]) for t in plain] == [(2, 26)]

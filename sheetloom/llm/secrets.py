"""Secret scan: fixed patterns plus a randomness test battery.

Strings long enough to judge are put to three tests under the hypothesis that
they are uniform over the alphabet of their inferred encoding: chi-squared of
the symbol counts, number of runs above and below the alphabet's middle, and
lag-1 serial correlation.  Fisher's method combines them.  Within each length
band, over all documents, the Benjamini-Hochberg procedure at rate ``RATE``
decides which strings are *not* random; the rest is reported as ``random``.
A run that mixes the signs of base64 and base64url is tested in pieces.
Bands keep short strings, on which the tests say little, from setting the limit
for long ones.

Null or empty text: no findings.  Spans count code points, end exclusive.
Repeated rows each get their own result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheetloom.llm.base import add_columns, keep, picked, ready, table

RATE = 0.05
MIN_LENGTH = 20
#: P values are compared as tenths of -ln p.
STEPS = 10
KINDS = ("assign", "access", "hex", "random")

#: The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

_assign = re.compile(ASSIGN, re.I | re.A)
# a run that is too short is dropped whole, so asking for the length in the pattern finds the same runs
_access = re.compile(r"AKIA[A-Z0-9]{14,}")
_hex = re.compile(r"[0-9a-f]{16,}")
_token = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
# pieces of a run that mixes the signs of both base64 alphabets
_pieces = (re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{20,}={0,2}"))
_letter, _digit = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), DIGITS + "abcdef", True),
    ("base32", re.compile(r"[A-Z2-7]+=*"), LOWER + "234567", True),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), DIGITS + LOWER, True),
    ("base64", re.compile(r"[A-Za-z0-9+/]+=*"), LOWER.upper() + LOWER + DIGITS + "+/", False),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+=*"), LOWER.upper() + LOWER + DIGITS + "-_", False),
)

_span = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
                      T.StructField("end", T.LongType())])
_tried = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                       T.StructField("band", T.IntegerType()), T.StructField("step", T.IntegerType()),
                       T.StructField("encoding", T.StringType())])
FIELDS = T.StructType([T.StructField("base", T.ArrayType(_span)), T.StructField("tried", T.ArrayType(_tried))])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def encoding_of(token: str) -> tuple[str, list[int], int] | None:
    """Name, symbol numbers and alphabet size of the narrowest encoding that fits; needs letters and digits."""
    body = token.rstrip("=")
    if not _letter.search(body) or not _digit.search(body):
        return None
    for name, pattern, alphabet, one_case in ENCODINGS:
        if pattern.fullmatch(token):
            at = {c: i for i, c in enumerate(alphabet)}
            return name, [at[c] for c in (body.lower() if one_case else body)], len(alphabet)
    return None


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans to test: runs, and where a run's signs fit no encoding its pieces in the alphabets of base64 and base64url."""
    for m in _token.finditer(text):
        s, e = m.span()
        if ("+" in m[0] or "/" in m[0]) and ("_" in m[0] or "-" in m[0]):
            yield from sorted({(s + x.start(), s + x.end()) for part in _pieces for x in part.finditer(m[0])})
        else:
            yield s, e


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniform_p(symbols: list[int], size: int) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty approximation."""
    n = len(symbols)
    counts = [0] * size
    for s in symbols:
        counts[s] += 1
    stat = sum(c * c for c in counts) * size / n - n
    df = size - 1
    z = ((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(symbols: list[int], size: int) -> float:
    """Wald-Wolfowitz test on symbols above and below the middle of the alphabet."""
    high = [2 * s >= size for s in symbols]
    n, a = len(high), sum(high)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(symbols: list[int], size: int) -> float:
    n = len(symbols)
    mean = sum(symbols) / n
    var = sum((s - mean) ** 2 for s in symbols)
    if var == 0:
        return 2.0 ** (1 - n)
    r = sum((x - mean) * (y - mean) for x, y in zip(symbols, symbols[1:])) / var
    return _two_sided((r + 1 / n) * math.sqrt(n))


def battery(symbols: list[int], size: int) -> float:
    """Fisher's combination of the three tests: a P value of randomness."""
    half = -sum(math.log(max(1e-300, f(symbols, size))) for f in (uniform_p, runs_p, serial_p))
    return math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0


def band_of(n: int) -> int:
    """Length band: half an octave from 20 on, open above."""
    return min(16, int(2 * math.log2(n / MIN_LENGTH)))


def _kernel():
    def run(texts):
        base, tried = [], []
        for text in texts.to_pylist():
            text = text or ""
            found = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            own = []
            for s, e in candidates(text):
                coded = encoding_of(text[s:e])
                if coded is None or len(coded[1]) < MIN_LENGTH or any(x <= s and e <= y for x, _, y in found):
                    continue
                name, symbols, size = coded
                p = battery(symbols, size)
                own.append({"start": s, "end": e, "band": band_of(len(symbols)), "encoding": name,
                            "step": int(min(1e6, -math.log(max(p, 1e-300)) * STEPS))})
            tried.append(own)
        return [base, tried]

    return run


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (spans of the fixed patterns) and ``tried`` (tested strings)."""
    ready(docs.sparkSession)
    return add_columns(docs, _kernel, FIELDS, text)


def limits(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per length band the step of -ln p from which strings are not random (a band that rejects none: absent).

    Counts over all documents; at most 17 bands come to the driver.
    """
    steps = (scanned.select(F.explode("tried").alias("t")).groupBy("t.band", "t.step").agg(F.count("*").alias("n")))
    up = Window.partitionBy("band").orderBy(F.desc("step"))
    ranked = steps.withColumns({"upto": F.sum("n").over(up), "m": F.sum("n").over(Window.partitionBy("band"))})
    passed = ranked.where(F.exp(-F.col("step") / STEPS) * F.col("m") <= F.lit(rate) * F.col("upto"))
    return {r["band"]: r["step"] for r in passed.groupBy("band").agg(F.min("step").alias("step")).collect()}


def secret_spans(scanned: DataFrame, limit: dict[int, int]) -> DataFrame:
    """``base`` and ``spans``: arrays of (start, kind, end), the latter with the strings held for random."""
    step = F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]) if limit else None

    def is_random(t: Column) -> Column:
        bound = step[t["band"]] if step is not None else F.lit(None).cast("int")
        return F.coalesce(t["step"] < bound, F.lit(True))

    extra = F.transform(F.filter("tried", is_random), lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", extra)))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = picked(table(ready(spark), d, "documents"), "doc_id", "text")
    scanned = keep(scan(docs).drop("text"))
    found = secret_spans(scanned, limits(scanned))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                        F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict[str, str] = {}

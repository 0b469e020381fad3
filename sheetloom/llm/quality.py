"""Quality rules, line first: each line is tried against punctuation, navigation, boilerplate and
repetition rules, failing lines are removed, and a document that loses too much text is rejected.

Null or empty text: no words, every count 0, rejected.  Lines without a word
never fail.  Repeated rows each get their own result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.base import WORD, add_columns, picked, ready, table
from sheetloom.llm.text import SPACE, slices, window_hashes

MIN_WORDS = 20
WINDOW = 8
#: Percent of words in repeated windows above which a document fails.
MAX_REPEATED = 30
#: Percent of words in failing lines above which a document is rejected.
MAX_LOSS = 50
#: Percent of symbols among a line's characters, of words with !! or ??, and of words that repeat
#: the word before, above which a line fails.
MAX_SYMBOLS, MAX_SHOUTS, MAX_ECHOES = 8, 30, 30
MIN_SEPARATORS, MENU_WORDS, NOTICE_WORDS = 3, 12, 25

SYMBOL = r"[#*$%&|<>]"
SHOUT = r"[!?][!?]+"
SEPARATOR = r"^[|>»›·•]$"
ENDING = r"[.!?…][\"'”’)]*[\x20\x09-\x0D]*$"
MENU = (r"(^|[^a-z])(home|menu|log in|login|sign in|sign up|next page|previous page|read more|click here|"
        r"share this|subscribe|contact us|about us|site map)([^a-z]|$)")
NOTICE = (r"(all rights reserved|copyright|©|cookie|privacy policy|terms of use|terms of service|javascript|"
          r"lorem ipsum|licensed under|released under the)")

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_word, _symbol, _shout, _ending, _menu, _notice = (
    re.compile(p) for p in (WORD, SYMBOL, SHOUT, ENDING, MENU, NOTICE))
_separators = frozenset("|>»›·•")

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_bad_lines", T.LongType()), T.StructField("lost_words", T.LongType()),
    T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType()),
])


def failed_rule(line: str, words: list[str]) -> str | None:
    """Name of the first rule that a line with words breaks."""
    n = len(words)
    chars = sum(map(len, words))
    if 100 * len(_symbol.findall(line)) > MAX_SYMBOLS * chars and sum(w in _separators for w in words) < MIN_SEPARATORS:
        return "punctuation"
    if 100 * len(_shout.findall(line)) > MAX_SHOUTS * n:
        return "punctuation"
    low = line.lower()
    if sum(w in _separators for w in words) >= MIN_SEPARATORS:
        return "navigation"
    if n <= MENU_WORDS and _menu.search(low) and not _ending.search(line):
        return "navigation"
    if n <= NOTICE_WORDS and _notice.search(low):
        return "boilerplate"
    if 100 * sum(a == b for a, b in zip(words, words[1:])) > MAX_ECHOES * n:
        return "repetition"
    return None


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows that occur at least twice."""
    windows = window_hashes(hashes, WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _kernel():
    def run(texts):
        out = [[] for _ in FIELDS]
        for part in slices(texts):
            hashes = part.word_hashes()
            n_words = np.diff(part.word_bounds)
            # continuation bytes of UTF-8 are no characters of their own
            chars = part.counts(~SPACE[part.data] & ((part.data & 0xC0) != 0x80))
            symbols = part.counts(_SYMBOLS[part.data])
            raw = part.data.tobytes()
            for i in range(len(part)):
                text = raw[part.bounds[i]:part.bounds[i + 1]].decode()
                n = int(n_words[i])
                repeated = repeated_words(hashes[part.word_bounds[i]:part.word_bounds[i + 1]])
                kept, seen, solid, bad, lost = [], set(), 0, 0, 0
                for line in text.split("\n"):
                    words = _word.findall(line)
                    if words:
                        solid += 1
                        seen.add(line)
                        if failed_rule(line, words):
                            bad += 1
                            lost += len(words)
                            continue
                    kept.append(line)
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
                row = (n, int(chars[i]), int(symbols[i]), solid - len(seen), repeated, failed, bad, lost,
                       not failed and 100 * lost <= MAX_LOSS * n, "\n".join(kept))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        return out

    return run


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``kept`` and ``clean_text`` (the lines that passed)."""
    ready(docs.sparkSession)
    return add_columns(docs, _kernel, FIELDS, text)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines; the other columns as they are."""
    judged = quality_rules(docs).where("kept")
    fixed = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return judged.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    judged = quality_rules(picked(table(spark, d, "documents"), "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_bad_lines", "lost_words")


def verdict_sql(source: str) -> str:
    """CTEs that end in ``verdict``: the counts, the lines and what became of them."""
    q = lambda s: s.replace("'", "''")
    return f"""
texts AS MATERIALIZED (SELECT *, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM {source}),
wins AS (SELECT doc_id, i, ws[i : i + {WINDOW - 1}] AS win
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins)
          WHERE n >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n
            FROM (SELECT doc_id, i, unnest(range({WINDOW})) AS j FROM twice) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM texts)),
lines AS MATERIALIZED (SELECT *, regexp_extract_all(line, '{WORD}') AS w FROM raw_lines),
tried AS MATERIALIZED (SELECT *, len(w) AS n,
  len(list_filter(w, lambda x: regexp_matches(x, '{SEPARATOR}'))) AS seps FROM lines),
judged AS MATERIALIZED (SELECT doc_id, line, pos, n, n > 0 AND (
     (100 * len(regexp_extract_all(line, '{SYMBOL}')) > {MAX_SYMBOLS} * length(array_to_string(w, ''))
        AND seps < {MIN_SEPARATORS})
  OR 100 * len(regexp_extract_all(line, '{SHOUT}')) > {MAX_SHOUTS} * n
  OR seps >= {MIN_SEPARATORS}
  OR (n <= {MENU_WORDS} AND regexp_matches(lower(line), '{MENU}') AND NOT regexp_matches(line, '{q(ENDING)}'))
  OR (n <= {NOTICE_WORDS} AND regexp_matches(lower(line), '{NOTICE}'))
  OR 100 * len(list_filter(range(2, n + 1), lambda k: w[k] = w[k - 1])) > {MAX_ECHOES} * n) AS bad FROM tried),
by_doc AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
                  count(*) FILTER (WHERE bad) AS n_bad_lines,
                  CAST(coalesce(sum(n) FILTER (WHERE bad), 0) AS BIGINT) AS lost_words,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS clean_text
           FROM judged GROUP BY doc_id),
verdict AS MATERIALIZED (SELECT *, NOT base_failed AND 100 * lost_words <= {MAX_LOSS} * n_words AS kept FROM (
  SELECT t.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '{SYMBOL}')) AS n_symbols, n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(ws) < {MIN_WORDS} OR 100 * coalesce(c.n, 0) > {MAX_REPEATED} * len(ws) AS base_failed,
         n_bad_lines, lost_words, clean_text
  FROM texts t JOIN by_doc USING (doc_id) LEFT JOIN covered c USING (doc_id)))"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": f"""WITH {verdict_sql("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bad_lines,
       lost_words FROM verdict"""}

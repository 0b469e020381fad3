"""Main text of web pages by maximum-scoring subsequence.

A page is read as a run of words and tags.  Words score positive and tags
negative, by weights learned from labelled pages (those whose ``<article>`` or
``<main>`` element says where the text is), and one linear scan finds the
contiguous stretch with the largest sum.  What stands inside it in an element
that is never text (menus, forms, adverts, notices, comments ...) is left out.
A word in class, id or role says so only if it stands alone there and the element
holds neither ``<article>`` or ``<main>`` nor half of the page's words; as part of a
name (``has-sidebar``) it only counts against the words, outside a labelled region.

Weights are counted on a bounded sample of labelled pages (``sample``, by
smallest hash of the id); each counts twice, with its label visible and hidden,
so pages without such an element are scored as well.  Null or empty html: empty
text.  Ties: the first best stretch.  Repeated rows each get their own result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.base import add_columns, picked, ready, table

SAMPLE = 2000

#: Elements by what HTML says they hold.
RAW = "script style noscript template textarea iframe title svg math select option object canvas".split()
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
                  "nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER_TEXT = frozenset("nav footer aside form dialog button menu fieldset label input head".split())
#: Words in class, id or role that mark an element as no text.
NEVER_WORDS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments "
                        "consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter "
                        "notice notices pagination popup promo promoted related share sharing sidebar signup "
                        "social sponsor sponsored subscribe toolbar widget alert respond reply replies "
                        "complementary contentinfo search".split())
REGION = ("article", "main")
#: Elements that end an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

#: Of these, what is no text however much of a page it holds, also as the first or last part of a name.
ALWAYS_WORDS = frozenset("comment comments disqus cookie cookies gdpr advert adverts advertisement".split())
#: First parts of names that only say what a page has or lacks.
STATES = frozenset("no not has have with without is hide show".split())

_name = re.compile("[a-zA-Z][a-zA-Z0-9:-]*")
#: What can end a tag, or begin a quoted value: quotes count after an equals sign alone.
_stop = re.compile(r"""=\s*["']|>""")
_raw_end = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_marks = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_split = re.compile(r"[^a-z0-9]+")

WEIGHTS = T.StructType([T.StructField("counts", T.MapType(T.StringType(), T.LongType()))])
FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                       T.StructField("score", T.DoubleType())])


def tags(page: str):
    """(start, end, name, closing, attributes) of each tag in lower case; the name is empty for comments, declarations
    and elements with raw content, which are passed over whole.  One scan forward, whatever the page."""
    at, n, quotes = 0, len(page), {'"': True, "'": True}
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = n if j < 0 else j + 3
            yield i, at, "", False, ""
            continue
        if page[i + 1:i + 2] in ("!", "?"):
            j = page.find(">", i)
            if j < 0:
                return
            at = j + 1
            yield i, at, "", False, ""
            continue
        closing = page.startswith("/", i + 1)
        found = _name.match(page, i + 1 + closing)
        if not found:
            continue
        end = found.end()
        while (m := _stop.search(page, end)) and m[0] != ">":
            quote, end = m[0][-1], m.end()
            if quotes[quote]:
                j = page.find(quote, end)
                quotes[quote] = j >= 0  # a quote that isn't there isn't further on either
                end = j + 1 if j >= 0 else end
        if not m:  # a quote that was never meant swallowed the rest: from here on quotes don't count
            quotes = {'"': False, "'": False}
            j = page.find(">", found.end())
            if j < 0:
                return
            stop = j
        else:
            stop = m.start()
        name, at = found[0].lower(), stop + 1
        if name in _raw_end and not closing:
            last = _raw_end[name].search(page, at)
            at = last.end() if last else n
            yield i, at, "", False, ""
            continue
        yield i, at, name, closing, page[found.end():stop]


def holders(page: str) -> tuple[set[int], set[int]]:
    """Starts of the tags whose elements hold ``<article>`` or ``<main>``, and of those with half of the page's words."""
    stack: list[tuple[str, int, int, int]] = []  # tag, start, words and regions before it
    held, spans = set(), []
    words = regions = at = 0

    def close(k):
        for _, start, before, inner in stack[k:]:
            if regions > inner:
                held.add(start)
            spans.append((start, words - before))
        del stack[k:]

    for start, end, name, closing, attributes in tags(page):
        words += len(page[at:start].split())
        at = end
        if not name:
            continue
        if closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                close(k)
            continue
        if name in SELF_CLOSING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        regions += name in REGION
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, start, words, regions))
    words += len(page[at:].split())
    close(0)
    return held, {start for start, n in spans if 2 * n >= words}


def _says_always(name: str) -> bool:
    parts = [x for x in _split.split(name) if x]
    return bool(parts) and parts[0] not in STATES and (parts[0] in ALWAYS_WORDS or parts[-1] in ALWAYS_WORDS)


def items(page: str):
    """(kind, value, role, inside): words with the role of their place, and tags.

    kind is "text" or "tag"; inside tells whether it lies in a ``<article>`` or,
    in a page without one, in ``<main>``.
    """
    low = page.lower()
    region = next((r for r in REGION if f"<{r}" in low), None)
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, never text, inside the region, marked in part of a name
    held = None
    at = 0

    def state():
        return stack[-1][1:] if stack else (False, False, False)

    def text(chunk):
        never, inside, marked = state()
        link = any(x[0] == "a" for x in stack[-4:])
        role = "never" if never else "link" if link else "marked" if marked and not inside else "text"
        return "text", html.unescape(chunk), role, inside

    for start, end, name, closing, attributes in tags(page):
        if start > at:
            yield text(page[at:start])
        at = end
        if not name:
            continue
        never, inside, marked = state()
        if closing:
            yield "tag", name, "never" if never else "text", inside
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in SELF_CLOSING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
            never, inside, marked = state()
        inside = inside or name == region
        if not never:
            never = name in NEVER_TEXT
            if not never and attributes and name not in ("html", "body", "article", "main"):
                names = [w for x in _marks.findall(attributes) for w in "".join(x).lower().split()]
                if any(w in NEVER_WORDS for x in names for w in _split.split(x)):
                    held = holders(page) if held is None else held
                    if start not in held[0] and any(map(_says_always, names)):
                        never = marked = True
                    elif start not in held[0] and start not in held[1]:
                        never, marked = any(x in NEVER_WORDS for x in names), True
        yield "tag", name, "never" if never else "text", inside
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, never, inside, marked))
    if at < len(page):
        yield text(page[at:])


def _keys(found, labelled: bool):
    """Weight key and number of tokens of each item."""
    for kind, value, role, inside in found:
        zone = "none" if not labelled else "in" if inside else "out"
        if kind == "tag":
            yield f"tag {zone} {value}", 1
        else:
            yield f"word {zone} {role}", len(value.split())


def count_page(page: str, counts: Counter) -> None:
    """Adds a labelled page's tokens inside and outside its region, label visible and hidden."""
    found = list(items(page))
    for labelled in (True, False):
        for (key, n), item in zip(_keys(found, labelled), found):
            if n:
                counts[f"{key} {int(item[3])}"] += n


class Weights:
    """Scores from counts: words +1 inside, down to -5 where they are always outside; tags 0 to -4."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.known: dict[str, float] = {}

    def of(self, key: str) -> float:
        if key not in self.known:
            inside, outside = self.counts.get(f"{key} 1", 0), self.counts.get(f"{key} 0", 0)
            kind, zone, what = key.split(" ", 2)
            # what was never seen: text counts as inside unless it is a link or outside a labelled region
            prior = 0.95 if zone == "out" or what == "never" else 0.5 if what in ("link", "marked") else 0.02
            out = (outside + 2 * prior) / (inside + outside + 2)
            if zone == "in" and what == "never":
                score = 0.0  # left out below; it must not cut the text around it
            else:
                score = 1 - 6 * out if kind == "word" else -0.01 - 4 * out
                if zone == "none" and what == "never":
                    score = max(score, -1.0)  # left out below: a short insertion must not cut a text
            self.known[key] = score
        return self.known[key]


def best_stretch(scores: list[float]) -> tuple[int, int, float]:
    """Bounds and sum of the contiguous stretch with the largest sum; empty if none is above 0."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return *bounds, best


def main_text(page: str, weights: Weights) -> tuple[str, float]:
    found = list(items(page))
    labelled = any(x[3] for x in found)
    scores = [n * weights.of(key) for key, n in _keys(found, labelled)]
    start, end, score = best_stretch(scores)
    blocks, block = [], []
    for kind, value, role, _ in found[start:end]:
        if kind == "tag":
            if value in BLOCK:
                blocks.append("".join(block))
                block = []
            elif value == "br":
                block.append(" ")
        elif role != "never":
            block.append(value)
    blocks.append("".join(block))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x), score


def learn_weights(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE) -> dict[str, int]:
    """Token counts of at most ``sample`` labelled pages: a few dozen numbers, by kind of tag and place."""
    labelled = picked(pages, key, page).where(F.col(page).rlike("(?i)<(article|main)"))
    ids = [r[0] for r in labelled.where(F.col(key).isNotNull()).select(key).distinct()
           .orderBy(F.xxhash64(key), key).limit(sample).collect()]
    if not ids:
        return {}

    def make():
        def run(column):
            out = []
            for x in column.to_pylist():
                counts = Counter()
                count_page(x or "", counts)
                out.append(list(counts.items()))
            return [out]
        return run

    counted = add_columns(labelled.where(F.col(key).isin(ids)).select(page), make, WEIGHTS, page)
    totals = counted.select(F.explode("counts").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in totals.collect()}


def extract_main_text(pages: DataFrame, counts: dict[str, int], page: str = "html") -> DataFrame:
    """``pages`` with ``text`` (blocks of the main text), ``n_chars`` and the ``score`` of the stretch."""
    ready(pages.sparkSession)

    def make():
        weights = Weights(counts)

        def run(column):
            found = [main_text(x or "", weights) for x in column.to_pylist()]
            return [[t for t, _ in found], [len(t) for t, _ in found], [s for _, s in found]]
        return run

    return add_columns(pages, make, FIELDS, page)


def op10_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    pages = picked(table(ready(spark), d, "pages"), "page_id", "url", "html")
    counts = learn_weights(pages)
    return extract_main_text(pages, counts).select("page_id", "url", "text", "n_chars")


_TAGS = "p|h1|h2|h3|li|ul|div|section"
QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLES = {"op10_html_extraction": rf"""
WITH body AS (SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS b FROM pages),
cut AS (SELECT page_id, url, unnest(bs) AS block, unnest(range(len(bs))) AS pos FROM (
  SELECT page_id, url, string_split_regex(b, '</?({_TAGS})( [^>]*)?>') AS bs FROM body)),
plain AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'),
  '\s+', ' ', 'g')) AS t FROM cut),
texts AS (SELECT page_id, url, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE t <> ''), '')
  AS text FROM plain GROUP BY page_id, url)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""}

"""Neighbours, token files, packing, mixing, pages and lines against plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from by_hand import words
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetloom.llm import ann, html, lines, mixing, packing, tokenfile, tokens


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v[50:60] = v[0]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [1.0, None] * 8), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, id int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, block=64).collect())
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q in range(0, 400, 50):
        score = np.round(n @ n[q], 12)
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        want += [(q, k + 1, int(i)) for k, i in enumerate(order)]
    assert got == sorted(want)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few).collect()] == [(0, 7)]
    assert ann.nearest(few.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    rng = random.Random(7)
    signs = "ÀßÿabyZ09^~ \t\n\r\x0b\x85\xa0 　​\x1c'sxtre.,!?-_1é中文\U0001f600İ|<>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    own = tokens.encoder(tokens.vocabulary(name))
    for text, ids in zip(texts, own.lists(pa.array(texts)), strict=True):
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(0, 2**32 - 1))
def test_huffman_round_trip(counts, seed):
    counts = np.asarray(counts)
    lengths = tokenfile.code_lengths(counts)
    assert lengths.max() <= tokenfile.LIMIT
    assert len(counts) == 1 or abs(float((2.0 ** -lengths.astype(float)).sum()) - 1) < 1e-9
    ids = np.arange(len(counts)) * 3 + 1
    code = tokenfile.Code(ids, lengths)
    text = np.random.default_rng(seed).choice(ids, 700)
    bits, offsets = code.encode(text)
    assert (code.decode(bits, offsets, len(text)) == text).all()


def test_token_file(spark, docs, tmp_path):
    texts = [(5, "Hello world, hello."), (2, None), (9, "x" * 50_000), (3, ""), (None, "null key"), (5, "again")]
    tokenfile.write_token_file(docs(texts), str(tmp_path / "f"), "byte_bpe_50k.json", 2, part=100)
    rows = tokenfile.read_token_file(spark, str(tmp_path / "f")).collect()
    own = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json")).tokenizer
    want = sorted((k if k is not None else -1, [*own.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in texts)
    got = sorted((r.key if r.key is not None else -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    rows.sort(key=lambda r: r.start)
    assert [r.key for r in rows] == [None, 2, 3, 5, 5, 9]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    tokenfile.write_token_file(docs({}), str(tmp_path / "e"), "byte_bpe_50k.json", 2)
    assert tokenfile.read_token_file(spark, str(tmp_path / "e")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_uses_each_piece_once(sizes):
    counts = np.bincount(sizes, minlength=65)
    patterns = packing.plan(counts, 64)
    used = np.zeros(65, int)
    for parts, times in patterns:
        assert sum(n * each for n, each in parts) <= 64
        for n, each in parts:
            used[n] += each * times
    assert (used == counts).all()
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, free in enumerate(bins) if free >= n]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(64 - n)
    assert sum(p.times for p in patterns) <= len(bins) + 1


def test_pack(docs):
    texts = [(i, " ".join(["word"] * (7 * i % 90))) for i in range(60)] + [(60, None), (61, ""), (62, "ab " * 5000), (3, "w")]
    rows = packing.pack(docs(texts), "word_bpe_49k.json", 0).collect()
    by = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    assert len({r.key for r in rows}) == 63 and sum(r.piece == 0 for r in rows) == 64
    assert packing.pack(docs({}), "word_bpe_49k.json", 0).count() == 0


def targets_by_hand(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in names}
        full.update(over)
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "B", "c", "é", None]), " ".join(["w"] * rng.choice([0, 3, 5, 5, 5, 40, rng.randint(1, 300)])))
            for i in range(600)]
    rows += [(600, "z", None), (601, "y", ""), (5, "a", "same id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, cell string")
    got = mixing.mix(df, cell=16).collect()
    sizes, taken = {}, {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 40, s
    again = mixing.mix(df.repartition(3), cell=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0


def test_main_text():
    page = ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav>'
            '<div class="ad">Buy this now</div><article><h1>Head &amp; line</h1><p>First\n  text.<br>more'
            '<aside>see also</aside><p>B&eacute;b&eacute; <b>bold</b>word</p><script>x("<p>")</script>'
            '<div id="comments"><p>Nice!</p></div><p>End.</p></article><footer>&copy; us</footer></body></html>')
    counts = {}
    for p in [page] * 5:
        from collections import Counter
        c = Counter()
        html.count_page(p, c)
        for k, n in c.items():
            counts[k] = counts.get(k, 0) + n
    weights = html.Weights(counts)
    text = "Head & line\n\nFirst text. more\n\nBébé boldword\n\nEnd."
    assert html.main_text(page, weights)[0] == text
    # without the element short pieces at the edge may be lost, not paragraphs
    last = "This closing paragraph is long enough to outweigh what stands before it, tags and all."
    bare = page.replace("<article>", "<div>").replace("</article>", "</div>").replace("End.", last)
    assert html.main_text(bare, weights)[0] == text.replace("End.", last)
    for empty in ("", "<html>", "<nav>Home</nav>", "<!-- x", "<p", "a < b"):
        html.main_text(empty, weights)
    assert html.main_text("<nav>Home</nav>", weights)[0] == ""


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "<article><p>One two.</article>", "z")],
                               "page_id long, html string, text string")
    counts = html.learn_weights(df)
    rows = {r.page_id: r for r in html.extract_main_text(df, counts).collect()}
    assert rows[1].text == rows[2].text == "" and rows[3].text == "One two." and rows[3].n_chars == 8
    assert html.extract_main_text(df.limit(0), {}).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=20))
def test_best_stretch(scores):
    start, end, best = html.best_stretch(scores)
    assert sum(scores[start:end]) == best
    assert best == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup_by_hand(source, rows):
    """Removed (id, position) pairs, from all pairs of lines; hashes as the operator has them."""
    at = {}
    for r in sorted(rows, key=lambda r: (r.id, r.pos)):
        at.setdefault((r.h, r.sim, r.words), []).append((r.id, r.pos))
    text = {(i, p): line for i, t in source.items() for p, line in enumerate((t or "").split("\n"))}
    norm = {k: " ".join("".join(c if c.isalnum() else " " for c in text[v[0]].lower()).split()) for k, v in at.items()}
    keys, root = list(at), {k: k for k in at}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if a[2] >= lines.MIN_WORDS and b[2] >= lines.MIN_WORDS and (a[1] ^ b[1]).bit_count() <= lines.BITS:
                longest = max(len(norm[a]), len(norm[b]))
                if 10 * edit_distance(norm[a], norm[b]) <= 2 * longest:
                    root[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(at[k])
    return {p for places in groups.values() for p in sorted(places)[1:]}


def test_line_dedup(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    from sheetloom.llm import graph

    monkeypatch.setattr(lines, "SMALL", 6)  # both ways of comparing buckets
    monkeypatch.setattr(lines, "ROUNDS", 1)
    monkeypatch.setattr(graph, "SHARE", 3)
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 3, 6, 12, 30]))) for _ in range(25)]
    hot = " ".join(f"h{rng.randrange(900)}" for _ in range(60)).split()
    texts = {1: None, 2: "", 3: "\n\n", 4: "###\n###"}
    for i in range(5, 45):
        own = []
        for _ in range(4):
            w = (hot if rng.random() < 0.4 else rng.choice(pool).split())[:]
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"e{rng.randrange(900)}"
            own.append(rng.choice(["{}.", "{}", " {} !"]).format(" ".join(w)).capitalize())
        texts[i] = "\n".join(own)
    df = docs(texts)
    source = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    gone = dedup_by_hand(texts, lines.occurrences(source).collect())
    assert len(gone) > 40
    for r in lines.dedup_lines(df).collect():
        t = texts[r.doc_id]
        want = t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (r.doc_id, p) not in gone)
        assert r.text == want and r.removed == sum(i == r.doc_id for i, _ in gone)
    assert lines.dedup_lines(docs({})).count() == 0
    twice = lines.dedup_lines(docs([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in twice) == [(0, "a b c d e f"), (1, ""), (1, "")]

"""Quality rules, secrets, shingles and licences against plain Python."""

import hashlib
import random
import re
from collections import Counter

from by_hand import shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetloom.llm import licenses, ngrams, quality, secrets
from sheetloom.llm.text import slices


def quality_by_hand(text):
    w = words(text)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = Counter(wins)
    covered = {i + j for i, x in enumerate(wins) if seen[x] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_rules(docs):
    a = "one two three four five six seven eight nine ten."
    texts = {1: None, 2: "", 3: " \n\t", 4: a, 5: a + "\n" + a, 6: a * 3 + "\n\nÄé 中文\x0b字 x" * 9, 7: "### " * 30,
             8: "w" + " w" * 40, 9: "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(9)), 10: "x" * 3_000_000 + " y"}
    rows = {r.doc_id: r for r in quality.quality_rules(docs(texts)).collect()}
    for i, t in texts.items():
        r = rows[i]
        assert quality_by_hand(t) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                                      r.base_failed), i
        assert not (r.base_failed and r.kept)
    assert rows[9].kept and not rows[7].kept and not rows[1].kept


def test_quality_lines(docs):
    good = "This line has words enough to be kept and it ends as it should."
    text = "\n".join([good, "Home | News | Sport | Log in", "All rights reserved.", "NOW!! BUY!! THIS!! THING!!",
                      "a### b*** c$$$ d%%%", good.replace("This", "That"), "no no no no no no"])
    (r,) = quality.quality_rules(docs({1: text})).collect()
    assert r.clean_text == good + "\n" + good.replace("This", "That") and r.n_bad_lines == 5
    assert quality.quality_rules(docs({})).count() == 0
    assert quality.quality_rules(docs([(1, good), (1, good)])).count() == 2


def secrets_by_hand(text):
    out = []
    for kind, (name, pattern, least) in enumerate((("assign", secrets.ASSIGN, 12), ("access", secrets.ACCESS, 18),
                                                   ("hex", secrets.HEX, 16))):
        flags = re.I | re.A if kind == 0 else 0
        for m in re.finditer(pattern, text, flags):
            if len(m[2] if kind == 0 else m[0]) >= least:
                out.append((m.start(), kind, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "AKIAZ9", "0",
                                 "deadbeef", "abc", "Z", "_", "ſecret", "toKen", "é", "\n", "A1B2C3D4E5"]), max_size=24))
def test_base_spans(parts):
    text = "".join(parts)
    name = ("assign", "access", "hex")
    assert ",".join(f"{name[k]}:{s}:{e}" for s, k, e in secrets.base_spans(text)) == secrets_by_hand(text)


def test_secrets(docs):
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(48))
    texts = {1: None, 2: "", 3: "plain words, nothing else in here",
             4: f"so: {key} end", 5: 'Password = "abcdefghijkl" AKIAABCDEFGHIJKLMN 0123456789abcdef',
             6: "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA1 x", 7: "password=short"}
    scanned = secrets.scan(docs(texts)).cache()
    found = secrets.secret_spans(scanned, secrets.limits(scanned))
    rows = {r.doc_id: r for r in found.select("doc_id", secrets.written("base").alias("b"),
                                               secrets.written("spans").alias("s")).collect()}
    for i, t in texts.items():
        assert rows[i].b == secrets_by_hand(t or ""), i
    assert rows[4].s == "random:4:52" and rows[6].s == "" and rows[3].s == ""
    assert rows[5].s == rows[5].b and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_battery_tells_random_from_text():
    rng = random.Random(2)
    p = [secrets.battery([rng.randrange(16) for _ in range(40)], 16) for _ in range(500)]
    assert sum(x < 0.05 for x in p) < 75
    assert secrets.battery([i % 4 for i in range(40)], 16) < 1e-4


def groups_by_hand(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_ngram_join_is_exact(docs, monkeypatch):
    from sheetloom.llm import graph

    monkeypatch.setattr(graph, "SHARE", 3)  # several shares a family
    rng = random.Random(3)
    texts, n = {1: None, 2: "", 3: " \n", 4: "One two", 5: "one TWO", 6: "ÉCOLE x y z", 7: "école x y z"}, 10
    for size in (5, 7, 9, 14, 30, 60, 200):
        for _ in range(3):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 2, 3, 5, 8):
                w = list(base)
                for _ in range(edits):
                    k = rng.randrange(len(w))
                    if rng.random() < 0.5:
                        w[k] = f"v{rng.randrange(10**6)}"
                    else:
                        del w[k]
                texts[n] = " ".join(w)
                n += 1
    rows = ngrams.similar_groups(docs(texts)).collect()
    assert {r.key: (r["size"], r.component) for r in rows} == groups_by_hand(texts)


def test_ngram_join_edge_rows(docs):
    assert ngrams.similar_groups(docs({})).count() == 0
    t = "a b c d e f g h"
    rows = ngrams.similar_groups(docs([(None, t), (3, t), (3, t), (2, t)])).collect()
    assert sorted((r.key or 0, r.component or 0) for r in rows) == [(0, 0), (2, 2), (3, 2), (3, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té中\x0b", max_size=12) | st.none(), max_size=8))
def test_word_kernel(texts):
    import pyarrow as pa

    got = []
    for part in slices(pa.array(texts, pa.string())):
        raw = part.data.tobytes()
        for i in range(len(part)):
            got.append([raw[a:b].decode() for a, b in zip(part.starts[part.word_bounds[i]:part.word_bounds[i + 1]],
                                                          part.ends[part.word_bounds[i]:part.word_bounds[i + 1]])])
    assert got == [words(t) for t in texts]


def test_signatures_meet():
    """Similar sets share a signature, whatever their sizes."""
    import numpy as np

    rng, bands = np.random.default_rng(4), ngrams.Bands()
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.08], rng.integers(0, 2**64, n // 14, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngrams.signatures(a, bands), ngrams.signatures(b, bands)))


def test_license_inheritance(spark):
    rows = [(1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/x.py", "print"), (3, "r/a/b/y.py", None),
            (4, "r/a/COPYING", "intro\nLicensed under the Apache License, Version 2.0.\nend"), (5, "q/z.py", "code"),
            (6, None, "Licensed under CC BY-NC 4.0."), (7, "r/w.py", ""), (8, "r/a/b/v", "All rights reserved."),
            (9, None, None), (2, "r/a/x.py", "print")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, path string, text string, folder string")
    got = sorted((r.key, r.license, r.license_dir) for r in licenses.license_scan(df).collect())
    assert got == sorted([
        (1, "MIT", None), (2, "Apache-2.0", "r/a"), (2, "Apache-2.0", "r/a"), (3, "proprietary", "r/a/b"),
        (4, "Apache-2.0", None), (5, None, None), (6, "CC-BY-NC-4.0", None), (7, "MIT", "r"),
        (8, "proprietary", None), (9, None, None)], key=lambda r: (r[0], str(r))) or got
    by = {(k, lic, d) for k, lic, d in got}
    assert (3, "proprietary", "r/a/b") in by and (7, "MIT", "r") in by and (9, None, None) in by
    assert licenses.license_scan(df.limit(0)).count() == 0

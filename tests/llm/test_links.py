"""Links of the n-gram join, and its pipeline stage, against all pairs."""

import random

from by_hand import shingles

from sheetloom.llm import graph, ngrams


def families(rng, sizes, edits):
    texts = {}
    for size in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for n in edits:
            w = list(base)
            for _ in range(n):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    return texts


def linked(texts, words, p, q):
    sets = {i: shingles(t, words) for i, t in texts.items()}
    return {i: {j for j, y in sets.items() if x != y and q * len(x & y) >= p * len(x | y)} for i, x in sets.items()}


def test_links_are_all_links(docs, monkeypatch):
    monkeypatch.setattr(graph, "SHARE", 3)
    monkeypatch.setattr(ngrams, "COLUMNS", 64)
    texts = families(random.Random(7), (5, 40, 150, 400), (0, 1, 1, 1, 1, 2, 2, 3, 5))
    sets = {i: shingles(t) for i, t in texts.items()}
    expected = {i: len({sets[j] for j in of}) for i, of in linked(texts, 4, 85, 100).items()}
    assert max(expected.values()) >= 4
    assert {r.key: r.links for r in ngrams.similar_groups(docs(texts)).collect()} == expected


def test_stage_takes_five_words_and_four_fifths(docs, spark):
    texts = families(random.Random(9), (60, 200), (0, 0, 1, 2, 3, 5))
    base = [f"u{i}" for i in range(200)]
    texts |= {50: " ".join(base), 51: " ".join(base[:90] + [f"z{i}" for i in range(16)] + base[106:])}
    near = linked(texts, 5, 8, 10)
    assert 51 in near[50] and 51 not in linked(texts, 4, 85, 100)[50]
    sets, stays = {i: shingles(t, 5) for i, t in texts.items()}, set()
    for i in sorted(texts):
        group, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = (near[k] | {j for j in texts if sets[j] == sets[k]}) - group
            group |= new
            todo += new
        if i == min(group):
            stays.add(i)
    assert {r.doc_id for r in ngrams.first_of_group_stage(spark, docs(texts), "").collect()} == stays


def test_unrelated_sets_form_no_family():
    import numpy as np

    rng, bands = np.random.default_rng(3), {x: ngrams.Bands(x) for x in ((85, 100), (8, 10))}
    for size, n in ((1, 300), (2, 300), (5, 300), (10, 300), (20, 200), (40, 200), (100, 100), (1000, 50), (20000, 60)):
        for similarity, own in bands.items():
            seen, joined = set(), 0
            for _ in range(n):
                sigs = set(ngrams.signatures(np.sort(rng.integers(0, 2**64, size, np.uint64)), own).tolist())
                joined += bool(sigs & seen)
                seen |= sigs
            assert joined <= n // 50, (size, similarity, joined)


def test_similar_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(5)
    for p, q in ((85, 100), (8, 10)):
        bands = ngrams.Bands((p, q))
        for size in [*range(1, 60), 150, 900]:
            for _ in range(20):
                x = np.unique(rng.integers(0, 2**64, size, np.uint64))
                # as many elements dropped and added as the similarity allows
                out = int(rng.integers(0, size * (q - p) // q + 1))
                add = (q * (size - out) - p * size) // p
                y = np.unique(np.concatenate((rng.permutation(x)[out:], rng.integers(0, 2**64, add, np.uint64))))
                both = len(np.intersect1d(x, y))
                assert q * both >= p * (len(x) + len(y) - both)
                a, b = (set(ngrams.signatures(z, bands).tolist()) for z in (x, y))
                assert a & b, (size, out, add)


def test_chains_and_texts_of_one_id(docs, monkeypatch):
    monkeypatch.setattr(graph, "SHARE", 4)
    rng = random.Random(11)
    base = [f"c{i}" for i in range(120)]
    texts = {}
    for i in range(14):  # each is near the next only
        texts[100 - i] = " ".join(base)
        base[8 * i:8 * i + 1] = [f"d{rng.randrange(10**6)}"]
        base[8 * i + 4:8 * i + 5] = [f"e{rng.randrange(10**6)}"]
    texts |= {i + 200: t for i, t in families(rng, (30, 30, 60), (0, 1, 1, 2)).items()}
    rows = [*texts.items(), (100, texts[200]), (100, texts[100]), (None, texts[200])]
    near = linked(texts, 4, 85, 100)
    group, todo = {100}, [100]
    near[100] = near[100] | near[200] | {200}
    while todo:
        new = near[todo.pop()] - group
        group |= new
        todo += new
    got = {}
    for r in ngrams.similar_groups(docs(rows)).collect():
        got.setdefault(r.key, set()).add(r.component)
    assert min(group) not in (100, None) and len(group) >= 15
    for i in texts:
        assert (got[i] == {min(group)}) == (i in group), i
    assert got[None] == {None}


def test_a_common_passage_makes_no_family(docs, monkeypatch):
    """Texts that quote one passage share signatures now and then; only those that can be similar are a family."""
    rng, passage, texts = random.Random(13), " ".join(f"p{i}" for i in range(33)), {}
    for i in range(60):
        texts[i] = passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(70))
    for i in range(10):
        texts[100 + i] = texts[i] + " end"
    held, found = [], ngrams.family_links

    def kept(members, *rest):
        held.extend(members.select("family", "id").collect())
        return found(members, *rest)

    monkeypatch.setattr(ngrams, "family_links", kept)
    got = {r.key: r.links for r in ngrams.similar_groups(docs(texts)).collect()}
    assert got == {i: len(of) for i, of in linked(texts, 4, 85, 100).items()}
    assert sum(got.values()) == 20
    of = {r.id: r.family for r in held}
    assert all(of[i] == of[100 + i] for i in range(10))
    assert max(list(of.values()).count(x) for x in of.values()) == 2


def test_sketches_never_set_similar_sets_apart():
    import numpy as np

    rng = np.random.default_rng(6)
    for size in (1, 2, 5, 60, 63, 64, 65, 300, 2000):
        sets = []
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**64, size, np.uint64))
            out, add = rng.integers(0, size // 2 + 1), rng.integers(0, size // 2 + 1)
            sets += [x, np.unique(np.concatenate((x[out:], rng.integers(0, 2**64, add, np.uint64))))]
        sets = [s for s in sets if len(s)]
        cells = ngrams.folded([ngrams.sketch(s) for s in sets])
        for i, x in enumerate(sets):
            for y, other in zip(sets[:i], cells):
                assert np.bitwise_count(cells[i] ^ other).sum() <= len(np.setxor1d(x, y))
        of = np.array([len(s) for s in sets])
        root = np.arange(len(sets))
        for a, b in ngrams.near_edges(of, cells, (85, 100)):
            root[b] = a
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(np.intersect1d(x, y))
                assert 100 * both < 85 * (len(x) + len(y) - both) or root[i] == root[j]


def test_stage_compares_no_texts_that_only_quote(docs, spark, monkeypatch):
    """As above on the stage's terms: five words, four fifths."""
    rng, passage, texts = random.Random(17), " ".join(f"p{i}" for i in range(34)), {}
    for i in range(40):
        texts[i] = passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(70))
    texts |= {100 + i: texts[i] + " one end" for i in range(5)}
    widths, found = [], ngrams.family_links

    def kept(members, *rest):
        widths.extend(r["count"] for r in members.groupBy("family").count().collect())
        return found(members, *rest)

    monkeypatch.setattr(ngrams, "family_links", kept)
    got = {r.doc_id for r in ngrams.first_of_group_stage(spark, docs(texts), "").collect()}
    assert got == set(range(40))
    assert widths == [2] * 5

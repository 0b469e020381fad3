"""Interaction of filters against sets of rows in plain Python."""

import random
from itertools import permutations

from by_hand import words
from hypothesis import given
from hypothesis import strategies as st

from sheetloom.llm import audit, base

numbers = st.lists(st.integers(0, 60), unique=True).map(sorted)


@given(st.lists(numbers, max_size=5), numbers, numbers)
def test_merges(lists, x, y):
    assert audit.union(lists) == sorted(set().union(*lists))
    assert audit.difference(x, y) == sorted(set(x) - set(y))
    assert audit.common(x, y) == len(set(x) & set(y))


@given(numbers, st.integers(-1, 61), st.integers(0, 60))
def test_gallop(x, value, at):
    at = min(at, len(x))
    assert audit.gallop(x, value, at) == next((i for i in range(at, len(x)) if x[i] >= value), len(x))


def failed(rows):
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = words(t)
        out.append({name for name, fails in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            any(c in "#$%&*|" for c in t), any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows),
        )) if fails})
    return out


def by_hand(rows, good, toxic):
    out, fails = {}, failed(rows)
    for part in {p or "" for _, _, p in rows}:
        own = [(rows[n][0], fails[n]) for n in range(len(rows)) if (rows[n][2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def result(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, row int")
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    base.ready(spark)
    found = audit.audit(base.keep(audit.text_flags(docs, named))).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in found}


def test_audit_is_exact(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE", 2)
    monkeypatch.setattr(audit, "PARTS", 2)
    rng = random.Random(3)
    pool = [None, "", " \n\t\x0b", "A# b", "wort " * 300, " ".join(f"w{i}" for i in range(250)), "é" * 100 + "AB", "x | y",
            " ".join(f"W{i}" for i in range(250)) + " & so", "z" * 200_000]
    pool += [" ".join(rng.choice(["aa", "Bb", "c$"]) + str(rng.randrange(n)) for _ in range(230)) for n in (5, 50, 500)]
    rows = [(i, rng.choice(pool), rng.choice(["a", "a", "b", None, "", "c"])) for i in rng.sample(range(-50, 50), 60)]
    rows += [rows[0], rows[0], (None, "A# b", "a"), (None, None, None), (7, "q", "b"), (7, "r", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-40, 40)]
    labels += [(None, 1, 1), (7, 1, 0), (7, 0, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    assert result(spark, rows, labels) == by_hand(rows, good, toxic)


def test_audit_of_nothing_and_of_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(base, "HOT", 5)
    assert result(spark, [], []) == {}
    rows = [(i, "same" if i % 3 else f"t{i}", "a") for i in range(40)] + [(5, "same", "a")] * 20
    assert result(spark, rows, [(5, 1, 1)]) == by_hand(rows, {5}, {5})

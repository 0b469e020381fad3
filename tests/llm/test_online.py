"""Sum-of-squares packing: the choice of levels by brute force, and whole round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetloom.llm import online, tokens


def levels(windows):
    return [sum(len(ids) for _, ids, _, _ in w) for level in windows.at_level for w in level]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_levels_have_the_smallest_sum_of_squares(sizes):
    windows = online.Windows(16)
    for n in sizes:
        rest = n % 16
        before = np.bincount(levels(windows), minlength=17)

        def squares(level):
            after = before.copy()
            after[level] -= level > 0
            after[level + rest] += 1
            return int((after[1:16] ** 2).sum())

        windows.add(0, np.zeros(n, np.uint32))
        after = np.bincount(levels(windows), minlength=17)
        assert (after == windows.counts).all() and after[0] == after[16] == 0 and windows.open == after.sum()
        if rest:
            options = [0] + [h for h in range(1, 17 - rest) if before[h]]
            assert (after[1:16] ** 2).sum() == min(map(squares, options))


def check(rows, texts, capacity, parts):
    own = tokens.encoder(tokens.vocabulary("word_bpe_49k.json"))
    places, pieces = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.key, r.doc_tokens), []).append((r.start, r.ids))
    short = 0
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0
        short += end < capacity
    assert short <= parts * capacity.bit_length()
    # copies of a document have the same pieces' ids, one after the other as often as it comes
    want = {}
    for key, text in texts:
        ids = own.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.setdefault((key, len(ids)), []).append(np.asarray(ids, "<u4").tobytes())
    assert pieces.keys() == want.keys()
    for name, found in pieces.items():
        if len(want[name]) == 1:
            end = 0
            for start, ids in sorted(found):
                assert start == end // 4
                end += len(ids)
            assert b"".join(ids for _, ids in sorted(found)) == want[name][0]
        else:
            assert sum(len(ids) for _, ids in found) == sum(map(len, want[name]))
    return len(places)


@pytest.mark.parametrize(("capacity", "limit"), [(2048, 4096), (64, 4096), (64, 6), (100, 3)])
def test_pack_online(docs, capacity, limit):
    rng = random.Random(capacity)
    texts = [(i, " ".join(["word", "paper"][i % 2:] * rng.randint(0, 90))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "ab " * 9000), (None, "no key"), (3, "w"), (3, "w"), (203, "<|endoftext|> é 中文")]
    rows = online.pack_online(docs(texts), "word_bpe_49k.json", 1, capacity, limit=limit).collect()
    n = check(rows, texts, capacity, 4)
    total = sum(r.length for r in rows)
    assert n <= total // capacity + 4 * capacity.bit_length()


def test_windows_that_nothing_fills_are_drained():
    windows = online.Windows(2048, 50)
    for i in range(2000):
        windows.add(i, np.full(1025, i, np.uint32))
        assert windows.open <= 51
    windows.finish()
    sizes = [sum(len(ids) for _, ids, _, _ in w) for w in windows.done]
    assert sum(sizes) == 2000 * 1025 and sum(n < 2048 for n in sizes) <= 11


def test_pack_online_of_nothing(docs):
    assert online.pack_online(docs({}), "word_bpe_49k.json", 1).count() == 0

"""Alignment of two tokenizers, against byte ranges compared one by one."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from sheetloom.llm import align, base
from sheetloom.llm.tokens import byte_signs, vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def by_hand(texts):
    first = Tokenizer.from_file(vocabulary(A))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    signs = {s: b for b, s in byte_signs().items()}

    def ranges(parts):
        out, at = [], 0
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs = []
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        raw_a = [bytes(signs[c] for c in first.id_to_token(i)) for i in a]
        names = [second.id_to_piece(i) for i in b]
        raw_b = [bytes([int(n[3:5], 16)]) if second.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            docs.append(([], [], [], ""))
            continue
        x, y = ranges(zip(a, raw_a)), ranges(zip(b, raw_b))
        links, j = [], 0
        for i, lo, hi in x:
            while y[j][2] <= lo:
                j += 1
            k = j
            while k < len(y) and y[k][1] < hi:
                links.append((i, y[k][0]))
                k += 1
        groups, start = [], 0
        for end in sorted({z[2] for z in x} & {z[2] for z in y}):
            groups.append("|".join(",".join(str(i) for i, lo, hi in side if start <= lo and hi <= end) for side in (x, y)))
            start = end
        docs.append((x, y, links, ";".join(groups)))
    count = Counter(p for d in docs for p in set(d[2]))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(count[p] == most[p[0]] for p in links),
             sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for x, y, links, g in docs]


def result(df, common):
    aligned = base.keep(align.align(df, A, B))
    rows = align.with_counts(aligned, base.keep(align.pair_counts(aligned)), common).collect()
    return [(r.key, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in rows]


@pytest.mark.parametrize("common", [align.COMMON, 40, 0])
def test_alignment(docs, common, monkeypatch):
    monkeypatch.setattr(align, "BYTES", 500)
    rng = random.Random(5)
    signs = "abcdefg  tion ing\t\n\r\x0b\x85\xa0　​'.,!?-1é中文\U0001f600İ<|>▁ﬁ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    vocab = ["internationalisation", "unbelievable", "Straße", "naïve", "tokenizers", "misaligned", "the", "of"]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " ", "  \n ", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "x" * 5000, "same", "same", "end  "]
    texts += ["the naïve tokenizers\n" * 3000]
    keys = list(range(len(texts)))
    keys[3] = None
    expected = sorted(zip(map(str, keys), by_hand(texts)))
    assert sum(x[1][0] == 0 for x in expected) >= 4 and sum(x[1][0] > 0 for x in expected) > 100
    assert sorted((str(k), v) for k, v in result(docs(list(zip(keys, texts))), common)) == expected


def test_alignment_of_nothing(docs):
    assert result(docs({}), 5) == []
    assert sorted(result(docs({1: None, 2: ""}), 5)) == [(1, (0,) * 6 + ("",)), (2, (0,) * 6 + ("",))]

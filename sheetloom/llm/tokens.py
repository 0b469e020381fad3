"""Token ids of whole texts with a public tokenizer file.

Both tokenizers cut a text where white space begins and never merge across such
a cut, so a text's ids are those of its units in turn: white space and the word
after it.  Units repeat a lot.  They are found and hashed for a megabyte of text
at once in numpy; each worker keeps the ids of units it has met in a table of
fixed size and asks the tokenizers library for new ones only.  Two units count
as the same by their 64-bit hash.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.base import add_columns, ready
from sheetloom.llm.text import Texts, slices

#: Slots of the table of units (two per hash), and ids it holds before it starts afresh.
SLOTS, HELD = 1 << 20, 1 << 23
#: Words kept with the ids of their merges.
WORDS = 200_000
#: Bytes of text at a time, beyond a single longer text.
BYTES = 1 << 20
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A byte-level vocabulary keeps white space: a blank belongs to the word after it.
KEEP_WHITE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
DROP_WHITE = re.compile(f"[^{_WHITE}]+")


#: Pieces of these characters alone are cut as every version of Unicode cuts them.
_LATIN, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
PLAIN = re.compile(f" ?[{_LATIN}0-9{_MARKS}]+")
PLAIN_KEEP = re.compile(f" ?[{_LATIN}]+| ?[0-9]+| ?[{_MARKS}]+")
PLAIN_DROP = re.compile(f"[{_LATIN}]+|[0-9]|[{_MARKS}]+")


def byte_signs() -> dict[int, str]:
    """The character a byte-level vocabulary writes for each byte: itself if it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: UTF-8 of white space beyond ASCII: it may touch a word, so such texts are not cut into units.
_odd_white = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.keeps_white = self.tokenizer.normalizer is None
        self.pattern, self.plain = (KEEP_WHITE, PLAIN_KEEP) if self.keeps_white else (DROP_WHITE, PLAIN_DROP)
        self.signs = byte_signs()
        self.words: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.first, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def word(self, word: str) -> bytes:
        """Ids of what the tokenizer takes for one word: the merges alone."""
        found = self.words.get(word)
        if found is None:
            if len(self.words) > WORDS:
                self.words.clear()
            tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.signs))
            found = self.words[word] = array("I", [t.id for t in tokens]).tobytes()
        return found

    def whole(self, text: str) -> bytes:
        """Ids of a unit or a text: plain pieces go to the merges word by word, others through the tokenizer."""
        out: list[bytes] = []
        for piece in self.pattern.findall(text):
            if PLAIN.fullmatch(piece):
                out += map(self.word, self.plain.findall(piece if self.keeps_white else piece.lower()))
            else:
                out.append(array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes())
        return b"".join(out)

    def learn(self, part: Texts, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Puts units into the table: in the first of their two slots if that is free, else in the second."""
        raw = part.data.tobytes()
        ids = [self.whole(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist())]
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total = int(count.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[:self.used], np.zeros(total + (1 << 20), np.uint32)))
        self.flat[self.used:self.used + total] = np.frombuffer(b"".join(ids), np.uint32)
        first = self.used + np.cumsum(count) - count
        self.used += total
        self.last_count = count
        one, two = _slots(hashes)
        slot = np.where(self.keys[one] == 0, one, two)
        self.keys[slot], self.first[slot], self.count[slot] = hashes, first, count

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash and whether it is there."""
        one, two = _slots(hashes)
        slot = np.where(self.keys[one] == hashes, one, two)
        return slot, self.keys[slot] == hashes

    def encode(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and the number of ids of each text."""
        if self.used > HELD:
            self.clear()
        cut = np.zeros(len(part.data) + 1, bool)
        cut[part.ends] = cut[part.bounds] = True
        cuts = np.flatnonzero(cut)
        starts, ends = cuts[:-1], cuts[1:]
        hashes = part.hashes(starts, ends) | np.uint64(1)  # 0 marks a free slot
        slot, there = self.find(hashes)
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        if not there.all():
            gone = np.flatnonzero(~there)
            new, at, which = np.unique(hashes[gone], return_index=True, return_inverse=True)
            before = self.used
            self.learn(part, new, starts[gone[at]], ends[gone[at]])
            # read from what was just appended: a slot may have been taken by another unit
            own = self.last_count
            first[gone] = (before + np.cumsum(own) - own)[which]
            count[gone] = own[which]
        ids = self.flat[_spread(first, count)]
        owner = np.searchsorted(starts, part.bounds)
        upto = np.concatenate(([0], np.cumsum(count)))[owner]
        return ids, np.diff(upto)

    def lists(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column (null: none)."""
        for part in slices(column, limit=BYTES):
            raw = part.data.tobytes()
            odd = _odd_white.search(raw) is not None
            ids, sizes = self.encode(part)
            ends = np.cumsum(sizes)
            for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                if odd:
                    text = raw[part.bounds[i]:part.bounds[i + 1]]
                    if _odd_white.search(text):
                        yield np.frombuffer(self.whole(text.decode()), np.uint32)
                        continue
                yield ids[a:b]


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes >> np.uint64(1)) & np.uint64(SLOTS - 1)).astype(np.int64), \
        ((hashes >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each stretch, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per worker process, so that later tasks find the pieces of earlier ones."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """A public vocabulary file by name; a path stays as it is."""
    return name if os.sep in name else public_tokenizers.path(name)


def small_ids(path: str, end_id: int) -> bool:
    """Whether all ids fit 16 bits."""
    return max(end_id, encoder(path).tokenizer.get_vocab_size() - 1) < 1 << 16


def with_ids(docs: DataFrame, path: str, end_id: int, text: str = "text", kind: str = "<u4") -> DataFrame:
    """``docs`` with ``ids`` (numbers of ``kind``, ``end_id`` last; null text: only that) and ``n_tokens``."""
    ready(docs.sparkSession)
    end = np.asarray([end_id], kind).tobytes()

    def make():
        own = encoder(path)

        def run(column):
            return [pa.array([x.astype(kind).tobytes() + end for x in own.lists(column)], pa.binary())]
        return run

    fields = T.StructType([T.StructField("ids", T.BinaryType())])
    return add_columns(docs, make, fields, text).withColumn("n_tokens", (F.octet_length("ids") / len(end)).cast("long"))

"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its word shingles.  Sizes are cut into bands; sets can
only be similar within a band or between neighbours, so each set gets signatures
for its own band and for the next.  In a band, two similar sets differ in at most
k shingles.  For k = 0 the whole set is the signature.  For small k the domain of
shingles is cut into k + 3 pieces, of which three agree: each choice of three gives
a signature.  For larger k the domain is cut into parts and each part into three
pieces; where a part holds at most one differing shingle, two of its three pieces
agree, so the hash of each pair of pieces is a signature.  (Parts may also stay
whole; then one without a differing shingle agrees.)  There are so many parts
that several must be of that kind, so a set whose empty pieces spoil fewer leaves
out the signatures of empty pieces, which unrelated sets would share.  No similar
pair is missed.

Sets of one text pattern that are not similar share a signature now and then, as two
that quote the same passage do where nothing else fell into a part.  So candidates are
held against sketches, the parities of their shingles in some number of cells: two
sets differ in at least as many shingles as their sketches differ in bits.  A set far
from the first one with its signature sends all that have the signature to a closer
look, in which only those are joined that can be similar by their sketches.  What is
joined directly or through others is a family; a passage that many sets quote makes
none, however many they are, and no similar pair is missed.

Each member of a family is compared once with the family's first set and turned into its difference from it.
Two members whose differences are small enough together are linked for certain;
these links are counted from a histogram of one number per member.  Only pairs that
this leaves open are compared, by blocks, on the differences: the symmetric
difference of two members is that of their differences.  A task counts the common
elements of two shares at a time by products of 0/1 matrices.  It returns numbers
of links and enough edges to join what is linked, so no pair is ever written.
Comparisons are exact, on sets of 64-bit shingle hashes.

Null or empty text, or one without words: an empty set, linked with nothing.
Fewer words than a shingle: the whole sequence is one.  Rows with the same id
count as one document, also when their texts differ; a null id gets no link.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sheetloom.functions.exprs import ident
from sheetloom.llm import graph
from sheetloom.llm.base import add_columns, keep, picked, ready, table
from sheetloom.llm.graph import components
from sheetloom.llm.text import Texts, mix, slices, window_hashes

WORDS = 4
#: Similarity as a fraction of whole numbers.
SIMILARITY = (85, 100)
#: What the pipeline's stage takes.
STAGE_WORDS = 5
STAGE_SIMILARITY = (8, 10)
#: Differing shingles up to which the domain is cut into pieces once.
FEW = 9

#: Shingles of a share, about; what a task holds is two shares.
SHARE_SHINGLES = 1 << 20
#: Sets a task remembers, to emit equal ones once.
SEEN = 1 << 22
#: Shingles (columns) of one matrix product.
COLUMNS = 4096
#: Members of families, some tens of bytes each, up to which all tasks get them, so that other texts stay where they are.
FEW_MEMBERS = 1 << 19
#: Times the bits that similar sets differ in at most, beyond which two sketches are far apart.
FAR = 2

SETS = T.StructType([T.StructField("size", T.LongType()), T.StructField("h1", T.LongType()),
                     T.StructField("h2", T.LongType()), T.StructField("sketch", T.BinaryType())])
_SALT1, _SALT2 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


class Bands:
    """Size bands for a similarity p / q: sets are similar only within a band or between neighbours."""

    def __init__(self, similarity: tuple[int, int] = SIMILARITY):
        self.p, self.q = similarity
        self.last = [0]  # the largest size of each band; band 0 is the empty set
        self.schemes: dict[int, tuple[int, int, int]] = {}

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            self.last.append((self.last[-1] + 1) * self.q // self.p)
        return int(np.searchsorted(self.last, size))

    def differing(self, band: int) -> int:
        """Shingles that similar sets up to the band's largest size differ in at most.

        That is (q - p) / (q + p) of the sum of their sizes.
        """
        while len(self.last) <= band:
            self.of(self.last[-1] + 1)
        return (self.q - self.p) * 2 * self.last[band] // (self.q + self.p)


    def scheme(self, band: int) -> tuple[int, int, int]:
        """(parts, pieces of a part, spare parts) for pairs in a band.

        The spare parts are as few as outnumber, in all but a few of ten thousand random sets, the parts that have no
        signature but one of empty pieces; where no number does for three pieces, parts of one piece are tried.
        """
        if band not in self.schemes:
            k, smallest = self.differing(band), self.last[band - 2] + 1 if band > 1 else 1
            options = []
            for pieces, needed in ((3, k // 2 + 1), (1, k + 1)):
                for spare in range(2, k + 6):
                    parts = needed + spare
                    agree = 2 if pieces == 3 else 1  # empty pieces that spoil a part
                    blank = parts * pieces * np.exp(-agree * smallest / (parts * pieces))
                    options.append((blank + 4 * blank**0.5 + 2 - spare, parts, pieces, spare))
            found = next((x for x in options if x[0] <= 0), None) or min(options)
            self.schemes[band] = found[1:]
        return self.schemes[band]


def shingle_sets(part: Texts, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes = part.word_hashes()
    for a, b in zip(part.word_bounds[:-1].tolist(), part.word_bounds[1:].tolist()):
        yield np.unique(window_hashes(hashes[a:b], min(words, max(1, b - a))))


def _cuts(shingles: np.ndarray, pieces: int) -> np.ndarray:
    """Bounds of equal ranges of the hash domain in a sorted set: each piece is a stretch."""
    limits = (np.arange(1, pieces, dtype=np.float64) / pieces * 2.0**64).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(shingles, limits), [len(shingles)]))


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of one set (sorted distinct hashes), for its own band and the next."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ _SALT1))))
    own = bands.of(len(shingles))
    out = []
    for band in (own, own + 1):
        k, salt = bands.differing(band), np.uint64(band << 40)
        if k == 0:
            out.append(mix(sums[-1:] + mix(np.array([salt]))))
            continue
        if k <= FEW:
            cuts = _cuts(shingles, k + 3)
            pieces = mix(sums[cuts[1:]] - sums[cuts[:-1]] + mix(np.arange(k + 3, dtype=np.uint64) + salt))
            chosen = np.array(list(combinations(range(k + 3), 3)))
            out.append(mix(pieces[chosen].sum(1) + mix((chosen @ np.array([64, 8, 1])).astype(np.uint64) + salt)))
            continue
        parts, pieces, spare = bands.scheme(band)
        cuts = _cuts(shingles, parts * pieces)
        held = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(parts, pieces)
        blank = (cuts[1:] == cuts[:-1]).reshape(parts, pieces)
        if pieces == 3:
            held = np.stack((held[:, 0] + mix(held[:, 1]), held[:, 0] + mix(held[:, 2] ^ _SALT1),
                             held[:, 1] + mix(held[:, 2] ^ _SALT2)), 1)
            blank = np.stack((blank[:, 0] & blank[:, 1], blank[:, 0] & blank[:, 2], blank[:, 1] & blank[:, 2]), 1)
        found = mix(held + mix(np.arange(parts * pieces, dtype=np.uint64).reshape(parts, pieces) + salt))
        if blank.any(1).sum() <= spare:
            found = found[~blank]
        out.append(found.reshape(-1))
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles in cells, two to four times as many as shingles: a power of two, so that halves fold."""
    cells = 1 << max(6, (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    held = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((held & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, with as many cells as the smallest of them."""
    least = min(map(len, sketches))
    rows = np.empty((len(sketches), least // 8), np.uint64)
    for i, x in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0)
    return rows


def set_columns(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` with the size of each set, two hashes and the sketch of it."""

    def make():
        def run(column):
            size, h1, h2, cells = [], [], [], []
            for part in slices(column, lower=True):
                for s in shingle_sets(part, words):
                    size.append(len(s))
                    h1.append(mix(s ^ _SALT1).sum().astype(np.int64))
                    h2.append(mix(s ^ _SALT2).sum().astype(np.int64))
                    cells.append(sketch(s))
            return [size, h1, h2, cells]
        return run

    return add_columns(docs, make, SETS, text)


def signature_rows(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(sig, id) of the sets of ``docs`` (text); ``id`` is the set's first hash, and a task emits equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(similarity), set()
        for batch in batches:
            for part in slices(batch.column(0), lower=True):
                sigs, owners = [], []
                for s in shingle_sets(part, words):
                    whole = int(mix(s ^ _SALT1).sum()) if len(s) else None
                    if whole is None or whole in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(whole)
                    own = signatures(s, bands)
                    sigs.append(own)
                    owners.append(np.full(len(own), whole, np.uint64))
                if sigs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64))],
                        names=["sig", "id"])

    return docs.mapInArrow(run, "sig long, id long")


def shared(rows: DataFrame) -> DataFrame:
    """(sig, id, first): different ids whose signature another id has, with the smallest id that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig0 = id0 = first0 = None
        sent0 = False
        for batch in batches:
            sig, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.concatenate(([sig[0] != sig0 or own[0] != id0], (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])))
            sig, own = sig[new], own[new]
            if not len(sig):
                continue
            goes_on = sig0 is not None and sig[0] == sig0
            start = np.concatenate(([True], sig[1:] != sig[:-1]))
            heads = np.flatnonzero(start)
            length = np.diff(np.concatenate((heads, [len(sig)])))
            first, many = np.repeat(own[heads], length), np.repeat(length, length) > 1
            if goes_on:
                run_len = int(heads[1]) if len(heads) > 1 else len(sig)
                first[:run_len] = first0
                many[:run_len] = True
                if not sent0:
                    yield pa.RecordBatch.from_arrays([pa.array([sig0]), pa.array([id0]), pa.array([first0])],
                                                     names=["sig", "id", "first"])
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[many]), pa.array(own[many]), pa.array(first[many])],
                                                 names=["sig", "id", "first"])
            sig0, id0, first0, sent0 = sig[-1], own[-1], first[-1], bool(many[-1])

    return (rows.repartition("sig").sortWithinPartitions("sig", "id")
            .mapInArrow(run, "sig long, id long, first long"))


def near_edges(size: np.ndarray, cells: np.ndarray, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs (first, other) that connect the sets of ``size`` as those do that can be similar by their sketches."""
    p, q = similarity
    left, out = np.arange(len(size)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            at = todo.pop()
            apart = np.bitwise_count(cells[left] ^ cells[at]).sum(1, dtype=np.int64)
            near = (q + p) * apart <= (q - p) * (size[left] + size[at])
            found = left[near].tolist()
            left = left[~near]
            todo += found
            out += [(int(root), x) for x in found]
    return out


def candidate_edges(held: DataFrame, classes: DataFrame, sketches: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): classes joined, directly or through others, with all that share a signature and can be similar.

    ``held`` is what ``shared`` gives, ``classes`` has (h1, class), ``sketches`` (class, size, sketch).
    """
    p, q = similarity

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[col.to_pylist() for col in batch.columns], strict=True)
            near = [(q + p) * int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) <= FAR * (q - p) * (m + n)
                    for *_, m, x, n, y in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, pa.bool_())],
                                             names=["id", "first", "a", "b", "near"])

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, size, cells = None, [], [], []

        def done():
            edges = near_edges(np.array(size), folded(cells), similarity) if len(name) > 1 else []
            own = np.array(name, np.int64)[np.array(edges, np.int64).reshape(-1, 2)]
            return [pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], names=["a", "b"])] if edges else []

        for batch in batches:
            for sig, c, n, x in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if sig != key:
                    yield from done()
                    key, name, size, cells = sig, [], [], []
                name.append(c)
                size.append(n)
                cells.append(x)
        yield from done()

    of = {x: classes.select(F.col("h1").alias(x), F.col("class").alias(y)) for x, y in (("id", "a"), ("first", "b"))}
    star = keep(held.where("id <> first").select("id", "first").distinct().join(of["id"], "id").join(of["first"], "first"))
    wanted = star.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    own = keep(sketches.join(wanted, "class"))
    side = {x: own.select(F.col("class").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_cells"))
            for x in ("a", "b")}
    sides = (star.join(side["a"], "a").join(side["b"], "b")
             .select("id", "first", "a", "b", "a_size", "a_cells", "b_size", "b_cells"))
    star = keep(sides.mapInArrow(tested, "id long, first long, a long, b long, near boolean"))
    far = keep(held.join(star.where("NOT near").select("id", "first").distinct(), ["id", "first"]).select("sig").distinct())
    members = held.join(far, "sig").select("sig", "id").join(of["id"].withColumnRenamed("a", "class"), "id").join(own, "class")
    looked = (members.select("sig", "class", "size", "sketch").repartition("sig").sortWithinPartitions("sig", "class")
              .mapInArrow(looked_at, "a long, b long"))
    return star.where("near").select("a", "b").unionByName(looked).where("a <> b")


def block_links(share: np.ndarray, sets: list[np.ndarray], size: np.ndarray, open_by: np.ndarray,
                similarity: tuple[int, int]) -> np.ndarray:
    """Which of the sets of ``size`` are similar, as a symmetric matrix: pairs of one share, or those between two.

    ``sets`` holds their differences from one set; only pairs whose sum of ``open_by`` is positive are asked for.
    """
    p, q = similarity
    asked = ~np.eye(len(sets), dtype=bool) if share.min() == share.max() else share[:, None] != share[None, :]
    asked &= open_by[:, None] + open_by[None, :] > 0
    own = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), own)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = held[column] > 1  # what one set alone has is in no intersection
    number = np.cumsum(held > 1) - 1
    owner, column = owner[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        width = int(column[hi - 1]) - start + 1
        has = np.zeros((len(sets), width), np.float32)  # sums of at most COLUMNS ones are exact
        has[owner[lo:hi], column[lo:hi] - start] = 1
        both += (has @ has.T).astype(np.int64)
    apart = own[:, None] + own[None, :] - 2 * both
    return asked & ((q + p) * apart <= (q - p) * (size[:, None] + size[None, :]))


def joining(link: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (first, other) that connect the rows of a link matrix as its links do."""
    left, out = np.ones(len(link), bool), []
    for r in range(len(link)):
        if not left[r]:
            continue
        left[r] = False
        found = np.array([r])
        while len(found):
            found = np.flatnonzero(link[found].any(0) & left)
            left[found] = False
            out += [(r, int(x)) for x in found]
    return out


DIFFERENCES = "family long, class long, size long, open_by long, diff binary"


def differences(members: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Members (family, class, size, id, mark), with their texts from (id, mark, text), as their differences from the set whose class is the family's name.

    ``open_by`` is (q + p) * size of the difference - (q - p) * size: two members are linked for certain when their
    sum is not above zero.  Members are dealt to shares; the first set goes to each share of its family.
    """
    p, q = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = np.zeros(0, np.uint64), None
        for batch in batches:
            family, cls, share = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            sets = (x for part in slices(batch.column(3), lower=True) for x in shingle_sets(part, words))
            for f, c, n, x in zip(family, cls, share, sets, strict=True):
                if (f, c, n) == last:  # a row that is there several times
                    continue
                last = f, c, n
                if f == c:
                    first = x
                    if n > 0:
                        continue
                diff = np.setxor1d(x, first, assume_unique=True)
                rows.append((f, c, len(x), (q + p) * len(diff) - (q - p) * len(x), diff.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, pa.binary() if i == 4 else pa.int64()) for i, col in enumerate(zip(*rows))],
                    names=["family", "class", "size", "open_by", "diff"])

    shares = F.ceil(F.greatest(F.count("*") / graph.SHARE, F.sum("size") / SHARE_SHINGLES)).cast("int")
    dealt = members.join(members.groupBy("family").agg(shares.alias("shares")), "family")
    is_first = F.col("family") == F.col("class")
    own = F.array(F.pmod(F.xxhash64("class"), "shares").cast("int"))
    dealt = dealt.withColumn("share", F.explode(F.when(is_first, F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(own)))
    # written first: the join then sees its size, and the texts stay where they are while it is small
    dealt = keep(dealt.select("family", "class", "share", (~is_first).cast("int").alias("after"), "id", "mark"))
    rows = texts.join(F.broadcast(dealt) if dealt.count() <= FEW_MEMBERS else dealt, ["id", "mark"])
    return (rows.repartition("family", "share").sortWithinPartitions("family", "share", "after", "class")
            .select("family", "class", "share", "text").mapInArrow(run, DIFFERENCES))


def open_links(open_members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b, links) of the pairs that differences leave open, from rows like those of ``differences``: edges (a <> b)
    that join what is linked, and numbers of links of a = b, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, share, name, size, open_by, held = None, [], [], [], [], []

        def done():
            if len(held) < 2:
                return []
            link, ids = block_links(np.array(share), held, np.array(size), np.array(open_by), similarity), np.array(name)
            n = link.sum(1)
            some = np.flatnonzero(n)
            edges = np.array(joining(link), np.int64).reshape(-1, 2)
            return [pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((ids[edges[:, 0]], ids[some]))),
                 pa.array(np.concatenate((ids[edges[:, 1]], ids[some]))),
                 pa.array(np.concatenate((np.zeros(len(edges), np.int64), n[some])))], names=["a", "b", "links"])]

        for batch in batches:
            for *block, s, c, n, v, x in zip(*[col.to_pylist() for col in batch.columns]):
                if block != key:
                    yield from done()
                    key, share, name, size, open_by, held = block, [], [], [], [], []
                for column, value in zip((share, name, size, open_by, held), (s, c, n, v, np.frombuffer(x, np.uint64))):
                    column.append(value)
        yield from done()

    weight = F.sum(F.octet_length("diff")) / 8
    shares = F.ceil(F.greatest(F.count("*") / graph.SHARE, weight / SHARE_SHINGLES)).cast("int")
    dealt = open_members.join(open_members.groupBy("family").agg(shares.alias("shares")), "family")
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("class"), "shares").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    blocks = dealt.select("family", "class", "size", "open_by", "diff", "share", other.alias("other")).select(
        "family", F.least("share", "other").alias("i"), F.greatest("share", "other").alias("j"), "share", "class", "size",
        "open_by", "diff")
    return (blocks.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
            .mapInArrow(run, "a long, b long, links long"))


def family_links(members: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b, links) of all linked pairs of members (see ``differences``), as ``open_links`` gives them."""
    found = keep(differences(members, texts, words, similarity))
    of = keep(found.groupBy("family").agg(F.max("open_by").alias("top"), F.min("open_by").alias("low"),
                                          F.min_by("class", F.struct("open_by", "class")).alias("centre")))
    # certain links of a member: members whose number is at most its own with the other sign, without itself
    counts = found.groupBy("family", "open_by").agg(F.count("*").alias("n"))
    asked = counts.select("family", (-F.col("open_by")).alias("at"), F.lit(0).cast("long").alias("n"), F.col("open_by"))
    points = counts.select("family", F.col("open_by").alias("at"), "n", F.lit(None).cast("long").alias("open_by"))
    upto = Window.partitionBy("family").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    sure = (points.unionByName(asked).withColumn("upto", F.sum("n").over(upto)).where("open_by IS NOT NULL")
            .select("family", "open_by", (F.col("upto") - (F.col("open_by") <= 0).cast("int")).alias("links"))
            .where("links > 0"))
    own = found.select("family", "class", "open_by").join(sure, ["family", "open_by"])
    own = own.select(F.col("class").alias("a"), F.col("class").alias("b"), "links")
    # the member nearest to the family's first set is linked with each that has a certain link
    star = found.select("family", "class", "open_by").join(of, "family").where(
        (F.col("open_by") + F.col("low") <= 0) & (F.col("class") != F.col("centre")))
    star = star.select(F.col("centre").alias("a"), F.col("class").alias("b"), F.lit(0).cast("long").alias("links"))
    still = found.join(of.where("top > 0").select("family", "top"), "family").where(
        F.col("open_by") + F.col("top") > 0).drop("top")
    return own.unionByName(star).unionByName(open_links(keep(still), similarity))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                   similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(key, size, component, links): one row per row of ``docs``; ``links`` counts the different sets similar to its set."""
    ready(docs.sparkSession)
    source = docs.select(F.col(ident(key)).cast("long").alias("id"), F.col(ident(text)).alias("text"),
                         F.xxhash64(F.col(ident(text))).alias("mark"))
    rows = keep(set_columns(source.withColumn("row", F.monotonically_increasing_id()), "text", words).drop("text"))
    there = rows.where("id IS NOT NULL AND size > 0")
    # a class is a distinct set, named by one of its rows; id and mark tell where its text is
    classes = keep(there.groupBy("size", "h1", "h2").agg(F.min(F.struct("row", "id", "mark")).alias("at"))
                   .select("size", "h1", "h2", F.col("at.row").alias("class"), "at.id", "at.mark"))
    named = keep(there.join(classes.select("size", "h1", "h2", "class"), ["size", "h1", "h2"]).select("id", "class").distinct())

    held = keep(shared(signature_rows(source.where("id IS NOT NULL").select("text"), words, similarity)))
    sketches = rows.select(F.col("row").alias("class"), "size", "sketch")
    families = components(candidate_edges(held, classes.select("h1", "class"), sketches, similarity))
    members = families.select(F.col("id").alias("class"), F.col("component").alias("family")).join(classes, "class")
    members = keep(members.select("family", "class", "size", "id", "mark"))
    found = keep(family_links(members, source, words, similarity))
    # texts of one id are one document
    several = named.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z")
    same = named.join(several, "id").where(F.col("class") != F.col("a")).select("a", F.col("class").alias("b"))
    final = components(found.where("a <> b").select("a", "b").unionByName(same))
    degree = found.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    placed = keep(named.join(final.withColumnRenamed("id", "class"), "class", "left").join(degree, "class", "left")
                  .select("id", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    smallest = placed.groupBy("component").agg(F.min("id").alias("smallest"))
    by_id = placed.join(smallest, "component").groupBy("id").agg(F.min("smallest").alias("component"), F.max("links").alias("links"))
    return (rows.join(by_id, "id", "left")
            .select(F.col("id").alias("key"), "size", F.coalesce("component", "id").alias("component"),
                    F.coalesce("links", F.lit(0)).cast("long").alias("links")))


def first_of_group_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id (of rows with the same id, one).

    Near duplicates share four fifths of their runs of five words; the defaults are those of ``op1`` only.
    """
    groups = similar_groups(docs, words=STAGE_WORDS, similarity=STAGE_SIMILARITY)
    dropped = groups.where(F.col("key") != F.col("component")).select(F.col("key").alias("doc_id")).distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    kept = docs.join(dropped, "doc_id", "left_anti")
    return kept.withColumn("__n", F.row_number().over(one)) \
        .where((F.col("__n") == 1) | F.col("doc_id").isNull()).drop("__n")


def op1_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    docs = picked(table(spark, d, "documents"), "doc_id", "text")
    return similar_groups(docs).select(F.col("key").alias("doc_id"), F.col("size").alias("n_shingles"),
                                       F.col("component").alias("component_id"), "links")


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLES: dict[str, str] = {}

"""SimHash near-duplicates, joined by fuzzy hashing with the binary Golay code.

*Fingerprints.*  64 bits: a bit is set if it is set in over half of the hashes of a
text's word shingles, repeats included.

*Fuzzy keys.*  The [23, 12] Golay code is perfect: every word of 23 bits lies within 3
bits of exactly one codeword.  ``nearby`` gives the codewords within 4 bits of a
segment: six if the nearest is 3 bits away, else that one alone.  Segments at most two
bits apart share one, as a word that is at most one bit from both decodes to a codeword
within 3 + 1 bits of both.

*Pigeonhole.*  A fingerprint has three segments.  Two errors leave, in cyclic order, a
segment without error followed by one with at most one (``PLACEMENTS`` are checked in
the tests), so linked fingerprints share a key made of one whole segment and a codeword
near the next.  Buckets of a key verify their members on all 64 bits.

*Large buckets.*  The 42 or 43 bits outside a bucket's whole segment are cut into five pieces, and
two errors spare three of them: members of a bucket over ``BUCKET`` are dealt by each
triple of pieces.  What is left free is 18 bits, so no bucket ever has more than 2**18
members, and they find each other by looking up their neighbours.

Equal fingerprints are one node, named by their least doc_id.  A bucket gives the
connected groups of its members as stars, never all its pairs; connectivity is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot, parts_for, partitions, pieces, utf8
from .components import components

#: Members of a bucket that are compared with each other; larger buckets are dealt anew.
BUCKET = 4096
#: Differing bits up to which fingerprints link.
ERRORS = 2

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GOLAY = 0b110001110101
#: (first bit, bits) of the three segments, and which of them follows which.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PLACEMENTS = ((0, 1), (1, 2), (2, 0))


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned integer; 0 without words."""
    counts, total, carried = np.zeros(64, np.int64), 0, []
    for piece in pieces(raw.lower(), rb"[\x20\x09-\x0D]"):
        run = carried + piece.split()
        if len(run) >= words:
            shingles = map(b" ".join, zip(*(islice(run, i, None) for i in range(words))))
            counts, total = counts + _bits(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), len(run) - words + 1), total + len(run) - words + 1
        carried = run[max(0, len(run) - words + 1):]
    if not total and carried:
        counts, total = _bits(iter([xxhash.xxh64_intdigest(b" ".join(carried), seed)]), 1), 1
    return int(((2 * counts > total).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _bits(hashes: Iterator[int], n: int) -> np.ndarray:
    """How many of ``n`` hashes have each bit set."""
    h = np.fromiter(hashes, np.uint64, n)
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(check bits of each message, nearest error of each syndrome, index changes to the codewords 4 bits away or -1)."""
    check = np.zeros(1 << 12, np.int64)
    for message in range(1 << 12):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GOLAY << (bit - 11)
        check[message] = rest
    words = (np.arange(1 << 12) << 11) | check
    light = words[np.bitwise_count(words) == 7]
    error, near = np.zeros(1 << 11, np.int64), np.full((1 << 11, 5), -1, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            syndrome = check[e >> 11] ^ (e & 0x7FF)
            error[syndrome] = e
            if weight == 3:  # a codeword 4 bits away differs from the nearest by seven bits that hold these three
                near[syndrome] = light[light & e == e] >> 11
    return check, error, near


def nearby(segments: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each segment: six columns, -1 where there are fewer."""
    check, error, near = golay()
    s = segments.astype(np.int64)
    syndrome = check[s >> 11] ^ (s & 0x7FF)
    index = (s ^ error[syndrome]) >> 11
    others = near[syndrome]
    return np.column_stack([index, np.where(others < 0, -1, index[:, None] ^ others)])


def segment(fp: np.ndarray, which: int) -> np.ndarray:
    first, size = SEGMENTS[which]
    return (fp >> np.uint64(first)) & np.uint64((1 << size) - 1)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of some fingerprints (uint64): at most 18 a row."""
    rows, keys = [], []
    for whole, next_ in PLACEMENTS:
        codes = nearby(segment(fp, next_))
        row, column = np.nonzero(codes >= 0)
        rows.append(row)
        keys.append((whole << 40) | (segment(fp, whole).astype(np.int64)[row] << 12) | codes[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def free_pieces(key: int) -> list[list[int]]:
    """The bits outside the whole segment of a key, in five runs."""
    first, size = SEGMENTS[key >> 40]
    bits = [b for b in range(64) if not first <= b < first + size]
    at = [len(bits) * i // 5 for i in range(6)]
    return [bits[a:b] for a, b in zip(at, at[1:])]


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def groups_by_pairs(fp: np.ndarray) -> np.ndarray:
    """For each fingerprint, the first of its connected group; each of them meets those that no group has yet."""
    label, left = np.arange(len(fp)), np.arange(len(fp))
    while len(left):
        front, left = left[:1], left[1:]
        seed = front[0]
        while len(front) and len(left):
            near = (np.bitwise_count(fp[front[:64], None] ^ fp[None, left]) <= ERRORS).any(axis=0)
            found, left = left[near], left[~near]
            label[found] = seed
            front = np.concatenate([front[64:], found])
    return label


def groups_by_lookup(fp: np.ndarray, free: list[int]) -> np.ndarray:
    """The same for sorted distinct fingerprints that differ in the bits ``free`` only, by looking up all neighbours."""
    masks = [_mask(list(c)) for n in range(1, ERRORS + 1) for c in combinations(free, n)]
    parent, before = np.arange(len(fp)), None
    while before is None or (parent != before).any():
        before = parent.copy()
        for mask in masks:
            at = np.minimum(np.searchsorted(fp, fp ^ mask), len(fp) - 1)
            a = np.flatnonzero(fp[at] == fp ^ mask)
            one, two = parent[a], parent[at[a]]
            np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return parent


def _stars(fp: np.ndarray, rep: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the least representative of its group."""
    least = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(least, label, rep)
    return rep[rep != least[label]], least[label][rep != least[label]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, triple, fp, rep) sorted by key and triple, as edges (a, b)."""
    held, now = [], None

    def close() -> tuple[np.ndarray, np.ndarray]:
        fp, rep = (np.concatenate(x) for x in zip(*held))
        fp, first = np.unique(fp.view(np.uint64), return_index=True)
        rep = rep[first]
        if now[1] < 0 or len(fp) <= BUCKET:
            return _stars(fp, rep, groups_by_pairs(fp))
        runs = free_pieces(now[0])
        kept = list(combinations(range(5), 3))[now[1] >> 27]
        return _stars(fp, rep, groups_by_lookup(fp, [b for i in range(5) if i not in kept for b in runs[i]]))

    for batch in batches:
        key, triple, fp, rep = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (triple[1:] != triple[:-1])))) if len(key) else []
        a, b = [], []
        for start, stop in zip(starts, [*starts[1:], len(key)]):
            this = (int(key[start]), int(triple[start]))
            if this != now and held:
                for into, x in zip((a, b), close()):
                    into.append(x)
                held = []
            now = this
            held.append((fp[start:stop], rep[start:stop]))
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})
    if held:
        a, b = close()
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and the fingerprint (as a signed long) of every row of ``docs`` (doc_id, text), without an exchange."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", utf8(F.col("text")).alias("raw")).mapInArrow(work, "doc_id long, fp long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        row, key = fuzzy_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_pydict({"key": key, "fp": fp[row], "rep": rep[row]})


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large buckets, once for each triple of pieces: its number above the 27 bits that its pieces have at most."""
    for batch in batches:
        key, fp, rep = (c.to_numpy() for c in batch.columns)
        for whole in np.unique(key >> 40):
            mine = key >> 40 == whole
            for n, kept in enumerate(combinations(free_pieces(int(whole) << 40), 3)):
                value, at = np.zeros(mine.sum(), np.int64), 0
                for bit in sum(kept, []):
                    value |= ((fp[mine].view(np.uint64) >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
                    at += 1
                yield pa.RecordBatch.from_pydict({"key": key[mine], "triple": (n << 27) | value, "fp": fp[mine], "rep": rep[mine]})


def link_classes(docs: DataFrame, *, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs`` (doc_id, text).

    Fingerprints link at ``ERRORS`` or fewer differing bits; a component's id is the
    least doc_id that links reach.  Null, empty and blank texts have the fingerprint
    zero and link like any other.  A row without doc_id links with nothing and has a
    null component; rows that repeat a doc_id with different texts are members of both
    texts' components, each under its own.  Texts of any length count whole, other
    columns play no part, and an empty table gives none.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "simhash")
    prints = tables.keep(fingerprints(docs, words=words, seed=seed), "prints", batch=500)
    nodes = tables.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    keyed = tables.keep(nodes.filter("rep is not null").select("fp", "rep").mapInArrow(_keyed, "key long, fp long, rep long"), "keyed")
    sizes = tables.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = join_hot(keyed, sizes, "key")
    few = met.filter(F.col("n") <= BUCKET).select("key", F.lit(-1).cast("long").alias("triple"), "fp", "rep")
    many = met.filter(F.col("n") > BUCKET).select("key", "fp", "rep").mapInArrow(_dealt, "key long, triple long, fp long, rep long")
    parts = max(partitions(spark), parts_for(spark, 32 * (sizes.agg(F.sum("n")).first()[0] or 0)))
    dealt = few.unionByName(many).repartition(parts, "key", "triple").sortWithinPartitions("key", "triple")
    links = tables.keep(dealt.mapInArrow(_links, "a long, b long").distinct(), "links")
    found = components(links).select(F.col("node").alias("rep"), F.col("label"))
    placed = tables.keep(nodes.join(found, "rep", "left").select("fp", "n", F.coalesce("label", "rep").alias("component_id")), "placed")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    out = tables.keep(join_hot(prints, placed, "fp").select("doc_id", digits.alias("fingerprint"), component), "out")
    tables.clear(keep=("out",))
    return out

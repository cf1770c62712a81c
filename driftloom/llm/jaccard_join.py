"""Exact Jaccard join of word n-gram sets as a metric-space join.

Jaccard distance is a metric, and sets link within the radius 1 - num / den.

1.  *Pivots.*  Word n-gram sets of unrelated texts are at distance 1 from each other,
    so pivots must be found where sets are near.  Hash classes cut every set into
    about as many parts as a linked pair can differ in, plus one: of two linked sets
    at least one non-empty part is equal.  Of the sets with an equal part the least
    member is the pivot.  A parity sketch, which bounds the symmetric difference from
    below, takes out what can't be near its pivot's other sets, whatever their number
    (a line that many texts share is such a part); what still hangs together over
    common pivots is a region, and every link lies inside one region.
2.  *Voronoi cells.*  In a region some members become pivots, every member gets its
    exact distance to each and belongs to the cell of the nearest one.  Members within
    the radius of a pivot are linked through it and need no comparison.
3.  *Windows.*  |d(x,p) - d(y,p)| <= d(x,y) for every pivot p, and d(y,p) - d(y,q) is
    at most twice the radius for members y of the cell of q that link into the cell
    of p: only boundary documents that both allow are replicated to another cell.
4.  *Recursion.*  Cells are cut again with pivots of their own until they are small;
    cells and their boundaries are then joined exactly.  Regions up to ``LEAF`` do
    this inside one task (``metric_forest``), larger ones first as blocks over many
    tasks (``_block_tasks``).  Tasks return a spanning forest of links, not all pairs.

A set is held as sorted 64-bit hashes; sets are compared exactly on these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot, partitions, parts_for, text_bytes, utf8
from .components import components

#: Members of a leaf, about, a long text counting as several; a task joins two at most.
LEAF = 256
#: Grams that make a text count once more.
MEMBER_GRAMS = 8192
#: Members of a pivot whose sketches a task holds, about; it meets two such blocks at most.
SIEVE_ROWS = 2048
#: Members up to which a cell is joined set by set.
FEW = 24
#: Blocks of a region that meet all others of it in one task.
BLOCKS = 64
#: Pivots that a family gets on average: about one a leaf, between these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 2, 16
#: Grams whose incidences a leaf holds at a time.
SLICE_GRAMS = 250_000
#: Cells of more members are cut again with pivots of their own, so many times.
CELL, DEPTH = 8192, 2
#: Bytes of pivot sets that are broadcast at most; more are joined by exchange.
PIVOT_BYTES = 64 << 20

_U = np.uint64
_TABLE = np.random.default_rng(411).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {_BASE: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS[base]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate(([_U(1)], np.full(size - 1, base, dtype=np.uint64))), dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-grams of a text; fewer words are one gram.

    A-Z is lower-cased and words are split at ASCII white space.  The hash of a gram
    is that of its words joined by one space, from one running polynomial hash.
    """
    tokens = raw.lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    text = np.frombuffer(b" ".join(tokens), dtype=np.uint8)
    gaps = np.flatnonzero(text == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))
    k = min(words, len(starts))
    starts, ends = starts[:len(starts) - k + 1], ends[k - 1:]
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[text] * _powers(_BASE, len(text)), out=total[1:])
    values = (total[ends] - total[starts]) * _powers(_INVERSE, len(text))[starts]
    return np.unique(_mix(values + (ends - starts).astype(np.uint64)))


def _rings(n: int, num: int, den: int) -> list[int]:
    """Rings of half octaves of set sizes: that of ``n`` and those of the smaller sets it can link with."""
    ring = lambda x: (x * x).bit_length() - 1  # noqa: E731  2 ** (ring / 2) <= x < 2 ** ((ring + 1) / 2)
    return list(range(ring(max(1, -(-num * n // den))), ring(n) + 1))


def signatures(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of non-empty parts of a set, for each ring of sizes it can link in.

    Linked sets x, y with |x| <= |y| differ in at most ``(den - num) * |x| // num``
    grams and are joined in the ring of |x|.  Each set sends its first ``limit + 1``
    non-empty parts, ``limit`` that bound: of the set whose last part comes first, one
    part is whole in the other, which sends it too.  A set with fewer non-empty parts,
    rare, also uses twice as many, and so on; two sets share all rounds up to the
    first one that is enough for either.
    """
    n = len(grams)
    if not n:
        return np.empty(0, dtype=np.uint64)
    inner, out = _mix(grams ^ _U(0xA5A5A5A55A5A5A5A)), []
    for ring in _rings(n, num, den):
        top = math.isqrt((1 << (ring + 1)) - 1)  # the greatest size of the ring
        limit = (den - num) * min(n, top) // num
        parts, turn = int(top * (den - num) / num * 1.04) + 1, 0
        while True:
            at = ((grams >> _U(13)) % _U(parts)).astype(np.int64)
            sums = np.zeros(parts, dtype=np.uint64)
            np.add.at(sums, at, inner)
            used = np.flatnonzero(np.bincount(at, minlength=parts))
            enough = len(used) > limit
            used = used[:limit + 1]
            out.append(_mix(_mix(sums[used] + used.astype(np.uint64) * _U(0xD1B54A32D192ED03)) + _U(64 * ring + turn)))
            if enough:
                break
            if turn > 60:
                raise RuntimeError("a set does not fall into enough parts")  # distinct hashes always do
            parts, turn = 2 * parts, turn + 1
    return np.concatenate(out)


#: Bits of a parity sketch: at least and at most so many, about one a gram between.
SKETCH_BITS, MOST_BITS = 1024, 1 << 16


def parity_sketch(grams: np.ndarray) -> bytes:
    """Bit i is the parity of the grams of hash class i: two sketches differ in at most as many bits as the sets in grams.

    Longer sets have longer sketches; a longer one folds to a shorter one's length.
    """
    bits = min(MOST_BITS, max(SKETCH_BITS, 1 << (len(grams) - 1).bit_length()))
    return np.packbits(np.bincount(((grams >> _U(40)) % _U(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


MAP_SCHEMA = "doc_id long, n long, print string, local long, sketch binary, part int, run binary"
#: Texts that a run is made of.
RUN_BYTES = 8 << 20


def _pack(ids: np.ndarray, counts: np.ndarray, sigs: np.ndarray) -> bytes:
    six = np.ascontiguousarray(sigs).view(np.uint8).reshape(-1, 8)[:, :6]
    return np.array([len(ids)], dtype=np.int64).tobytes() + ids.tobytes() + counts.astype(np.uint32).tobytes() + six.tobytes()


def _unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(run, np.int64, 1)[0])
    ids = np.frombuffer(run, np.int64, n, 8)
    counts = np.frombuffer(run, np.uint32, n, 8 + 8 * n)
    six = np.frombuffer(run, np.uint8, offset=8 + 12 * n).reshape(-1, 6)
    sigs = np.zeros((len(six), 8), dtype=np.uint8)
    sigs[:, :6] = six
    return np.repeat(ids, counts), sigs.view(np.uint64).ravel()


def _regions(words: int, num: int, den: int, parts: int):
    """Per text: its id, set size, set print and the first copy that the task has seen; per 8 MB of texts: runs of signatures."""
    import hashlib

    names = ["doc_id", "n", "print", "local", "sketch", "part", "run"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def out(*cols):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def close(ids: list[int], sigs: list[np.ndarray]) -> pa.RecordBatch | None:
        if not ids:
            return None
        owner, every = np.repeat(np.arange(len(ids)), [len(s) for s in sigs]), np.concatenate(sigs)
        part = ((every >> _U(48)) % _U(parts)).astype(np.int64)
        order = np.argsort(part * len(ids) + owner, kind="stable")
        owner, every, part = owner[order], every[order], part[order]
        cuts, known, keys, runs = np.searchsorted(part, np.arange(parts + 1)), np.array(ids, dtype=np.int64), [], []
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                who, counts = np.unique(owner[cuts[p]:cuts[p + 1]], return_counts=True)
                keys.append(p)
                runs.append(_pack(known[who], counts, every[cuts[p]:cuts[p + 1]]))
        none = [None] * len(keys)
        return out(none, none, none, none, none, keys, runs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        ids, sigs, size = [], [], 0
        for batch in batches:
            if len(first) > 100_000:
                first.clear()
            rows = []
            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                grams = shingles(raw, words)
                mark = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                local, sketch = ident, None
                if ident is not None and len(grams):
                    local = first.setdefault(mark, ident)
                    if local == ident:
                        sketch = parity_sketch(grams)
                        ids.append(ident)
                        sigs.append(signatures(grams, num, den))
                        size += len(raw)
                rows.append((ident, len(grams), mark.hex(), local, sketch, (ident or 0) * 2654435761 % 2**32 * parts >> 32, None))  # texts need no company: they are spread by id
                if size >= RUN_BYTES:
                    yield close(ids, sigs)
                    ids, sigs, size = [], [], 0
            if rows:
                yield out(*zip(*rows, strict=True))
        if ids:
            yield close(ids, sigs)

    return work


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts as they are; for each group of equal signatures of a part, edges from its least member.

    Rows come by part, and one part is held at a time.
    """
    held: list[bytes] = []
    now = None
    names = ["doc_id", "n", "print", "local", "sketch", "other"]

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids, sigs = (np.concatenate(x) for x in zip(*map(_unpack, held), strict=True))
        held.clear()
        order = np.lexsort((ids, sigs))
        ids, sigs = ids[order], sigs[order]
        first = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
        lead = np.repeat(ids[first], np.diff(np.append(first, len(ids))))
        pairs = np.unique(np.column_stack((ids, lead))[ids != lead], axis=0)
        if len(pairs):
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), none, pa.nulls(len(pairs), pa.string()), none, pa.nulls(len(pairs), pa.binary()), pa.array(pairs[:, 1])], names)

    for batch in batches:
        part, run = batch.column(5).to_pylist(), batch.column(6)
        for p, x in zip(part, run, strict=True):
            if x.is_valid:
                if p != now:
                    yield from close()
                    now = p
                held.append(x.as_py())
        rows = batch.filter(pa.array([not x.is_valid for x in run], pa.bool_()))
        if len(rows):
            yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.nulls(len(rows), pa.int64())], names)
    yield from close()


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric adjacency matrix, breadth first."""
    new, out = np.ones(len(near), dtype=bool), []
    for start in range(len(near)):
        if not new[start]:
            continue
        new[start], todo = False, [start]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & new)
            new[found] = False
            out += [(i, int(j)) for j in found]
            todo += found.tolist()
    return out


def sieve_forest(sketches: list[bytes], sizes: np.ndarray, num: int, den: int, split: int = 0) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that their sketches don't rule out, with ``split`` > 0 only of those across it; a pair is compared at the shorter sketch's length."""
    lengths, n = np.array([len(s) for s in sketches]), len(sketches)
    may = np.zeros((n, n), dtype=bool)
    left = np.arange(n) < (split or n)
    for length in np.unique(lengths):
        for side, other in ((left, ~left), (~left, left)) if split else ((left, left),):
            mine, longer = np.flatnonzero((lengths == length) & side), np.flatnonzero((lengths >= length) & other)
            if not len(mine) or not len(longer):
                continue
            short, folded = (np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint8).reshape(-1, length), axis=0) for i in at]) for at in (mine, longer))
            apart = np.zeros((len(mine), len(longer)), dtype=np.float32)
            for lo in range(0, length, 512):  # 4096 bits at a time
                x, y = (np.unpackbits(s[:, lo:lo + 512], axis=1).astype(np.float32) for s in (short, folded))
                apart += x.sum(1)[:, None] + y.sum(1)[None, :] - 2 * (x @ y.T)
            may[np.ix_(mine, longer)] = apart <= (den - num) * np.minimum(sizes[mine, None], sizes[None, longer]) // num
    return _forest(may | may.T)


def linked_forest(sets: list[np.ndarray], split: int, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets``; with ``split`` > 0 only links across it.

    Intersections are counted by products of incidence matrices over slices of the grams.
    """
    sets = [s.view(np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    a, b = slice(0, split or len(sets)), slice(split, len(sets))
    common = np.zeros((a.stop, len(sets) - split), dtype=np.float32)
    # sets are sorted: ranges of hash values are slices of each, and bound what is held at a time
    turns = int(sizes.sum()) // SLICE_GRAMS + 1
    bounds = np.array([i * 2**64 // turns for i in range(1, turns)], dtype=np.uint64)
    cuts = [np.concatenate(([0], np.searchsorted(s, bounds), [len(s)])) for s in sets]
    for k in range(turns):
        owner = np.repeat(np.arange(len(sets)), [c[k + 1] - c[k] for c in cuts])
        _, column, count = np.unique(np.concatenate([s[c[k]:c[k + 1]] for s, c in zip(sets, cuts, strict=True)]), return_inverse=True, return_counts=True)
        shared = count > 1
        keep = shared[column]
        owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(shared.sum()), 2048):
            i, j = np.searchsorted(column, (lo, lo + 2048))
            block = np.zeros((len(sets), 2048), dtype=np.float32)
            block[owner[i:j], column[i:j] - lo] = 1
            common += block[a] @ block[b].T
    common = common.astype(np.float64)
    links = den * common >= num * (sizes[a][:, None] + sizes[b][None, :] - common)
    if not split:
        return _forest(links)
    near = np.zeros((len(sets), len(sets)), dtype=bool)
    near[a, b], near[b, a] = links, links.T
    return _forest(near)


def pivot_distances(sets: list[np.ndarray], pivots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(common grams, Jaccard distances) of all sets to the pivots among them, both exact."""
    sets = [s.view(np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    common = np.zeros((len(sets), len(pivots)), dtype=np.int64)
    for k, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(sets[p], flat), len(sets[p]) - 1)
        hits = np.concatenate(([0], np.cumsum(sets[p][at] == flat)))
        common[:, k] = hits[ends] - hits[ends - sizes]
    union = sizes[:, None] + sizes[pivots][None, :] - common
    return common, 1 - common / union


def metric_forest(sets: list[np.ndarray], num: int, den: int, few: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among non-empty ``sets``: pivots, Voronoi cells, windows, recursion.

    A cell that its pivots can't divide is joined set by set.
    """
    few, n = few or FEW, len(sets)
    if n <= few:
        return linked_forest(sets, 0, num, den) if n > 1 else []
    sizes, radius, up = np.array([len(s) for s in sets]), 1 - num / den + 1e-9, list(range(n))
    out: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(i: int, j: int) -> None:
        a, b = top(i), top(j)
        if a != b:
            up[b] = a
            out.append((i, j))

    def labels(at: np.ndarray) -> set[int]:
        return {top(int(i)) for i in at}

    wanted = max(2, min(MOST_PIVOTS, n // few))
    pivots = [i * n // wanted for i in range(wanted)]
    common, d = pivot_distances(sets, pivots)
    union = sizes[:, None] + sizes[pivots][None, :] - common
    for i, k in zip(*np.nonzero(den * common >= num * union), strict=True):
        link(pivots[k], int(i))
    home = d.argmin(1)
    for k in range(wanted):
        cell = np.flatnonzero(home == k)
        if not len(cell):
            continue
        # inside the cell
        if len(labels(cell)) > 1:
            inner = linked_forest([sets[i] for i in cell], 0, num, den) if len(cell) == n else metric_forest([sets[i] for i in cell], num, den, few)
            for i, j in inner:
                link(int(cell[i]), int(cell[j]))
        # over its boundary: members of later cells that every window lets in
        inside = ((d >= d[cell].min(0) - radius) & (d <= d[cell].max(0) + radius)).all(1) & (d[:, k] - d[np.arange(n), home] <= 2 * radius)
        guests = np.flatnonzero(inside & (home > k))
        if len(guests) and len(labels(cell) | labels(guests)) > 1:
            for i, j in linked_forest([sets[i] for i in (*cell, *guests)], len(cell), num, den):
                at = np.concatenate((cell, guests))
                link(int(at[i]), int(at[j]))
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _by_key(solve):
    """Rows sorted by their first column, one group at a time, to edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(_values(c) for c in batch.columns), strict=True):
                if row[0] != key:
                    if held:
                        found += solve(held)
                    key, held = row[0], []
                held.append(row)
            if found:
                yield _edges(found)
        if held and (found := solve(held)):
            yield _edges(found)
        pa.default_memory_pool().release_unused()

    return work


def _values(column: pa.Array) -> list:
    """Python values; lists of numbers as arrays of their own."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[i:j].copy() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _leaves(num: int, den: int):
    """Rows (task, side, doc_id, grams) of one task to the edges of its spanning forest."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r[1], r[2]))
        split = sum(r[1] == 0 for r in rows) if rows[-1][1] else 0
        if rows[0][1]:
            return []
        sets = [r[3] for r in rows]
        forest = linked_forest(sets, split, num, den) if split else metric_forest(sets, num, den)
        return [(rows[i][2], rows[j][2]) for i, j in forest if rows[i][2] != rows[j][2]]

    return _by_key(solve)


def _sieve(num: int, den: int):
    """Rows (task, side, doc_id, n, sketch) of one task to edges of what may be linked."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r[1], r[2]))
        if rows[0][1]:
            return []
        split = sum(r[1] == 0 for r in rows) if rows[-1][1] else 0
        forest = sieve_forest([r[4] for r in rows], np.array([r[3] for r in rows]), num, den, split)
        return [(rows[i][2], rows[j][2]) for i, j in forest]

    return _by_key(solve)


def _sieve_tasks(members: DataFrame) -> DataFrame:
    """Rows (task, side, doc_id, n, sketch) of ``members`` (lead, size, doc_id, n, sketch): the members of a lead in blocks by hash, each pair of blocks a task."""
    blocks = F.ceil((F.col("size") + 1) / SIEVE_ROWS).cast("int")
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("doc_id", F.lit(5)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    task = F.concat_ws("/", F.col("lead").cast("string"), F.least("mine", "other").cast("string"), F.greatest("mine", "other").cast("string"))
    return dealt.select(task.alias("task"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "doc_id", "n", "sketch")


def _join_leaves(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """``tasks``: rows (task, side, doc_id, grams), each task of two leaves at most."""
    return tasks.repartition(partitions(tasks.sparkSession), "task").sortWithinPartitions("task").select("task", "side", "doc_id", "grams").mapInArrow(_leaves(num, den), "a long, b long")


def _distances(tables: Scratch, members: DataFrame, by: str, num: int, den: int) -> DataFrame:
    """(by, doc_id, pivot, d, linked): exact distances of all members to the pivots of their group.

    Every member is a pivot with a seeded chance; the least member is one always.
    """
    stats = tables.keep(members.groupBy(by).agg(F.count("*").alias("size"), F.min("doc_id").alias("least")), "pivot-stats")
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(77)), 11) / F.lit(float(1 << 53))
    wanted = F.greatest(F.lit(LEAST_PIVOTS), F.least(F.lit(MOST_PIVOTS), F.col("size") / LEAF))
    pivots = (join_hot(members, stats, by, "size").filter((chance < wanted / F.col("size")) | (F.col("doc_id") == F.col("least")))
              .select(by, F.col("doc_id").alias("pivot"), F.col("grams").alias("pivot_grams")).dropDuplicates([by, "pivot"]))
    pivots = tables.keep(pivots, "pivots")
    held = pivots.agg(F.sum(F.size("pivot_grams") * 8)).first()[0] or 0
    side = F.broadcast(pivots) if held <= PIVOT_BYTES else pivots
    common = F.size(F.array_intersect("grams", "pivot_grams"))
    union = F.size("grams") + F.size("pivot_grams") - F.col("common")
    return (members.join(side, by).withColumn("common", common)
            .select(by, "doc_id", "pivot", (1 - F.col("common") / union).alias("d"), (F.lit(den) * F.col("common") >= F.lit(num) * union).alias("linked")))


def _block_tasks(tables: Scratch, large: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(leaf tasks, links) of the regions in ``large`` (family, doc_id, grams).

    Links are those of members to pivots within the radius; leaf tasks are the pairs
    of blocks whose windows meet and whose members aren't all one class by then.
    """
    radius = 1 - num / den + 1e-9
    near = tables.keep(_distances(tables, large, "family", num, den), "distances")
    stars = near.filter("linked and doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    balls = tables.keep(components(stars), "balls").select(F.col("node").alias("doc_id"), F.col("label").cast("string").alias("ball"))
    cells = near.groupBy("family", "doc_id").agg(F.min(F.struct("d", "pivot")).alias("n")).select("family", "doc_id", F.array("n.pivot").alias("cell"), F.col("n.d").alias("d"))
    for _ in range(DEPTH):
        cells = tables.keep(cells, "cells")
        big = cells.groupBy("family", "cell").count().filter(F.col("count") > CELL).select("family", "cell")
        if not big.limit(1).count():
            break
        big = F.broadcast(big)  # cells of more than CELL members: at most one for so many rows
        again = tables.keep(large.join(cells.join(big, ["family", "cell"], "left_semi"), ["family", "doc_id"]).withColumn("group", F.struct("family", "cell")), "again")
        inner = tables.keep(_distances(tables, again, "group", num, den), "inner")
        finer = inner.groupBy("group", "doc_id").agg(F.min(F.struct("d", "pivot")).alias("n")).select(F.col("group.family").alias("family"), "doc_id", F.col("n.pivot").alias("sub"), F.col("n.d").alias("sd"))
        cells = cells.join(finer, ["family", "doc_id"], "left").select("family", "doc_id", F.when(F.col("sub").isNull(), F.col("cell")).otherwise(F.concat("cell", F.array("sub"))).alias("cell"), F.coalesce("sd", "d").alias("d"))
    # a cell's blocks: runs of distance slots of one ball that hold a leaf's worth; a fuller slot is cut by hash
    weights = large.select("family", "doc_id", (1 + F.size("grams") / MEMBER_GRAMS).alias("w"))
    placed = tables.keep(cells.join(balls, "doc_id", "left").join(weights, ["family", "doc_id"])
                         .select("family", "doc_id", "cell", F.coalesce("ball", F.lit("-")).alias("ball"), F.floor(F.col("d") * 64).cast("int").alias("slot"), "w"), "placed")
    at = ["family", "cell", "ball", "slot"]
    counts = placed.groupBy(*at).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    before = F.sum("w").over(Window.partitionBy("family", "cell", "ball").orderBy("slot"))
    cuts = tables.keep(counts.select(*at, "n", F.floor((before - F.col("w")) / LEAF).alias("run"), F.ceil(F.col("w") * 0.9 / LEAF).alias("cuts")), "cuts")
    salt = F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("doc_id", F.lit(3)), "cuts")).otherwise(0)
    whole = F.when(F.col("cuts") > 1, F.col("slot")).otherwise(-1)
    blocks = tables.keep(join_hot(placed, cuts, at).select("family", "doc_id", "ball", F.xxhash64("family", "cell", "ball", "run", whole, salt).alias("block")), "blocks")
    # windows: the range of distances of each block to each pivot of its family
    ranges = blocks.join(near, ["family", "doc_id"]).groupBy("family", "block", "ball", "pivot").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    spans = tables.keep(ranges.groupBy("family", "block", "ball").agg(F.sort_array(F.collect_list(F.struct("pivot", "lo", "hi"))).alias("r")), "spans")  # a row a block, some MOST_PIVOTS ranges
    salts = spans.groupBy("family").agg(F.ceil(F.count("*") / BLOCKS).alias("salts"))
    salted = tables.keep(spans.join(salts, "family"), "salted")
    left = salted.select("family", F.pmod(F.xxhash64("block"), "salts").alias("salt"), F.col("block").alias("a"), F.col("ball").alias("aball"), F.col("r").alias("ar"))
    right = salted.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("block").alias("b"), F.col("ball").alias("bball"), F.col("r").alias("br"))
    apart = F.array_max(F.zip_with("ar", "br", lambda x, y: F.greatest(y["lo"] - x["hi"], x["lo"] - y["hi"])))
    one_class = (F.col("aball") == F.col("bball")) & (F.col("aball") != "-")
    pairs = tables.keep(left.join(right, ["family", "salt"]).filter((F.col("a") <= F.col("b")) & ~one_class).filter(apart <= radius).select("a", "b", "ar", "br", F.concat_ws("/", F.lit("b"), "family", "a", "b").alias("task")), "pairs")
    # a task gets the members of either block that lie in the windows of the other; a block against itself has one side
    sides = pairs.select("task", F.lit(0).alias("side"), F.col("a").alias("block"), F.when(F.col("a") != F.col("b"), F.col("br")).alias("r"))
    sides = sides.unionByName(pairs.filter("a <> b").select("task", F.lit(1).alias("side"), F.col("b").alias("block"), F.col("ar").alias("r")))
    at = near.groupBy("family", "doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pivot", "d"))), lambda x: x["d"]).alias("ds"))
    members = tables.keep(blocks.join(at, ["family", "doc_id"]).select("block", "doc_id", "ds"), "members")
    inside = F.col("r").isNull() | ~F.exists(F.zip_with("ds", "r", lambda d, r: (d < r["lo"] - radius) | (d > r["hi"] + radius)), lambda out: out)
    wanted = sides.join(members, "block").filter(inside).select("task", "side", "doc_id")
    return wanted.join(large.select("doc_id", "grams"), "doc_id").select("task", "side", "doc_id", "grams"), stars


def _named(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with ``__name``, whether names differ from ids): a number for each id and text, the id itself for one text of each id.

    Other texts of an id, told apart by the 64-bit hash ``__print``, are named by a hash of both.
    """
    printed = docs.withColumn("__print", F.xxhash64("text"))
    several = printed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("__print").alias("__first"), F.max("__print").alias("__last")).filter("__first <> __last").select("doc_id", "__first")
    if several.limit(1).count() == 0:
        return printed.withColumn("__name", F.col("doc_id")), False
    named = printed.join(several, "doc_id", "left")
    other = F.col("__first").isNotNull() & (F.col("__first") != F.col("__print"))
    return named.withColumn("__name", F.when(other, F.xxhash64("doc_id", "__print")).otherwise(F.col("doc_id"))).drop("__first"), True


def join_classes(docs: DataFrame, *, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    Two documents link when ``den * |intersection| >= num * |union|`` of their sets;
    a component's id is its least doc_id.  Null and empty texts have an empty set
    and are linked with nothing; a row without doc_id links with nothing and has a
    null component.  Rows that repeat an id and its text are one document, rows that
    share an id alone are several.  Texts of any length count whole, other columns play
    no part, and an empty table gives none.
    """
    named, differ = _named(docs.select("doc_id", "text"))
    if not differ:
        return _classes(docs, words, num, den)
    tables = Scratch(docs.sparkSession, "jaccard-names")
    names = tables.keep(named.filter("__name is not null").select(F.col("__name").alias("name"), F.col("doc_id").alias("id")).distinct(), "names")
    found = _classes(named.select(F.col("__name").alias("doc_id"), "text"), words, num, den)
    placed = tables.keep(found.join(names, found["doc_id"] == names["name"], "left").select("id", "n_shingles", "component_id"), "placed")
    least = tables.keep(placed.filter("component_id is not null").groupBy("component_id").agg(F.min("id").alias("least"), F.count("*").alias("n")), "least")
    linked = join_hot(placed.filter("component_id is not null"), least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    out = tables.keep(linked.unionByName(placed.filter("component_id is null").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")), "out")
    tables.clear(keep=("out",))
    return out


def _classes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``join_classes`` where no id has more than one text."""
    spark = docs.sparkSession
    tables = Scratch(spark, "jaccard")
    parts = parts_for(spark, text_bytes(docs))
    rows = docs.select("doc_id", utf8(F.col("text")).alias("raw")).mapInArrow(_regions(words, num, den, parts), MAP_SCHEMA)
    met = rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet, "doc_id long, n long, print string, local long, sketch binary, other long")
    met = tables.keep(met, "met", batch=500)
    texts = met.filter("n is not null").drop("other")  # ``sketch`` only where the row leads its batch
    # equal sets are one class; a task has sent one member of each or a few, the rest hang on it
    heads = texts.filter("n > 0 and doc_id = local").select("doc_id", "print").distinct()
    classes = heads.join(heads.groupBy("print").agg(F.min("doc_id").alias("rep")), "print").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    classes = tables.keep(classes, "classes")
    near = met.filter("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()
    near = tables.keep(near.join(classes.select(F.col("doc_id").alias("a"), F.col("rep").alias("doc_id")), "a").select("doc_id", "b"), "near-pivots")
    led = tables.keep(near.groupBy("b").agg(F.count("*").alias("n")).join(classes.select(F.col("doc_id").alias("b"), F.col("rep").alias("lead")), "b"), "led")
    near = tables.keep(join_hot(near, led, "b").filter("doc_id <> lead").select("lead", "doc_id").distinct(), "near")
    heads = tables.keep(texts.filter("sketch is not null").select("doc_id", "n", "sketch").join(classes.select("doc_id", "rep"), "doc_id").filter("doc_id = rep").drop("rep").dropDuplicates(["doc_id"]), "heads")
    groups = tables.keep(near.groupBy("lead").agg(F.count("*").alias("size")), "groups")
    sized = join_hot(near, groups, "lead", "size")
    members = sized.select("lead", "size", "doc_id").unionByName(groups.select("lead", "size", F.col("lead").alias("doc_id"))).join(heads, "doc_id")
    sieved = _sieve_tasks(members).repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_sieve(num, den), "a long, b long")
    families = components(tables.keep(sieved, "sieved", batch=500)).select(F.col("node").alias("doc_id"), F.col("label").alias("family"))
    tables.drop("near", "near-pivots", "led", "heads")

    def as_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(x.as_py(), words).view(np.int64) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.int64()))], ["family", "doc_id", "grams"])

    # families grow with the table: a merge join at any size, so that cost stays in proportion
    members = docs.select("doc_id", utf8(F.col("text")).alias("raw")).join(families.hint("merge"), "doc_id").select("family", "doc_id", "raw")
    sets = tables.keep(members.mapInArrow(as_grams, "family long, doc_id long, grams array<long>").filter(F.size("grams") > 0), "sets", batch=500)
    sized = tables.keep(sets.groupBy("family").agg(F.count("*").alias("size"), F.sum(1 + F.size("grams") / MEMBER_GRAMS).alias("weight")), "sizes")
    known = join_hot(sets, sized, "family", "size")
    tasks = known.filter(F.col("weight") <= LEAF).select(F.concat(F.lit("f/"), F.col("family").cast("string")).alias("task"), F.lit(0).alias("side"), "doc_id", "grams")
    stars = None
    if sized.filter(F.col("weight") > LEAF).limit(1).count():
        large = tables.keep(known.filter(F.col("weight") > LEAF).select("family", "doc_id", "grams"), "large")
        more, stars = _block_tasks(tables, large, num, den)
        tasks = tasks.unionByName(more)
    links = _join_leaves(tasks, num, den)
    links = tables.keep(links if stars is None else links.unionByName(stars), "links", batch=500)
    found = components(links).select(F.col("node").alias("rep"), F.col("label").alias("component"))
    placed = classes.join(found, "rep", "left").select(F.col("doc_id").alias("local"), F.coalesce("component", "rep").alias("component"))
    out = texts.join(placed, "local", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = tables.keep(out, "out")
    tables.clear(keep=("out",))
    return out


def keep_one(docs: DataFrame, *, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id, and of its texts the least by hash.

    Rows that repeat an id and its text count as one, rows that share an id alone are
    several documents, so no text goes that nothing kept is linked with.  Rows without
    doc_id stay.  All columns stay as they were.
    """
    named, differ = _named(docs)
    found = _classes(named.select(F.col("__name").alias("doc_id"), "text"), words, num, den).filter("doc_id is not null")
    if differ:
        ids = named.filter("__name is not null").select("__name", "doc_id", "__print").distinct()
        placed = ids.join(found.select(F.col("doc_id").alias("__name"), "component_id").distinct(), "__name")
        kept = placed.groupBy("component_id").agg(F.min_by("__name", F.struct("doc_id", "__print")).alias("__name")).select("__name")
    else:
        kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__name")).distinct()
    rows = named.filter("doc_id is not null").join(kept, "__name", "left_semi").dropDuplicates(["__name"])
    return rows.select(*docs.columns).unionByName(docs.filter("doc_id is null"))

"""Removal of repeated 100-byte strings with a sparse, distributed suffix sort.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier, in
a document of smaller id or before in the same one.

1.  *Anchors.*  Of the k-mers in each window of ``LENGTH`` bytes the one of least
    hash is its anchor; equal windows have equal anchors at the same offset.
2.  *Candidates.*  Packed runs of anchor hashes are exchanged; anchors whose k-mer
    occurs once are done with, which leaves the suffixes that can match at all.
3.  *Suffix runs.*  Each task sorts the suffixes at its candidates (k-mer, the
    bytes after it, then those before it in reverse), drops equal ones, front-codes
    the sorted run and sends it to the part of its k-mer.
4.  *Merge.*  A part merges its runs with a loser tree over longest common
    prefixes: streams are compared from the prefix on that they are known to share.
    Suffixes of one k-mer come out together with the prefixes that they share; what a
    suffix shares with an earlier one, by these prefixes, are its spans.
5.  *Hot k-mers* don't meet in one task: their strings are told by 128 bits of hash,
    and the first occurrence of each is a pre-aggregated minimum.

Whole copies of a text are told by SHA-256 first; only the least id takes part.
"""

from __future__ import annotations

import atexit
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FREE_SHUFFLES, Scratch, drop_table, join_hot, parts_for, settings, text_bytes, utf8

LENGTH = 100
KMER = 40
#: Bytes on either side of an anchor that a string around it can have.
SIDE = LENGTH - KMER
WIDTH = KMER + 2 * SIDE
#: Bytes of text that a run of anchors, and one of suffixes, is made of.
RUN_BYTES, SUFFIX_RUN_BYTES = 8 << 20, 4 << 20
#: A k-mer is hot beyond so many occurrences, or one in so many of all anchors: that bounds the list of them.
HOT, HOT_SHARE = 1 << 16, 200_000

_U = np.uint64
_TABLE = np.random.default_rng(2718).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0xBF58476D1CE4E5B9
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * (0 if have is None else len(have)))
        _POWERS[base] = have = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(size - 1, base, dtype=np.uint64))), dtype=np.uint64)
    return have[:n]


def window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every string of ``length`` bytes."""
    n = len(text) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[text] * _powers(_BASE, len(text)), out=total[1:])
    x = (total[length:] - total[:-length]) * _powers(pow(_BASE, -1, 2**64), n)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def _running(x: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """Least or greatest of each run of ``width`` values, in two passes over blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, fill, dtype=x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    before = pick.accumulate(blocks, axis=1).ravel()
    after = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(after[:n], before[width - 1:width - 1 + n])


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the k-mers that are least in some window of ``LENGTH`` bytes."""
    if len(text) < LENGTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h, width, top = window_hashes(text, KMER), SIDE + 1, np.iinfo(np.uint64).max
    least = _running(h, width, np.minimum, top)
    wide = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    wide[width - 1:width - 1 + len(least)] = least
    at = np.flatnonzero(_running(wide, width, np.maximum, _U(0)) == h)
    return at, h[at]


def _compress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _decompress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _delta(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _anchor_runs(parts: int):
    """Rows (part, run) with one entry per k-mer of a run, and (doc_id, pos) of those it holds more often."""
    names, types = ["doc_id", "pos", "part", "run"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def close(ids: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc = np.repeat(np.array(ids, dtype=np.int64), [len(p) for p, _ in found])
        if not len(doc):
            return
        pos, h = np.concatenate([p for p, _ in found]), np.concatenate([x for _, x in found])
        _, first, code, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        often = count[code] > 1
        if often.any():
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.array(doc[often]), pa.array(pos[often].astype(np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        # in the order of the text, so that ids and positions shrink to small steps
        order = np.sort(first)
        doc, pos, h, count = doc[order], pos[order], h[order], count[code[order]].astype(np.uint32)
        part = (h >> _U(48)) % _U(parts)
        keys, runs = [], []
        for p in range(parts):
            at = np.flatnonzero(part == p)
            if len(at):
                six = h[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                keys.append(p)
                runs.append(struct.pack("<q", len(at)) + six + _compress(_delta(doc[at]) + _delta(pos[at].astype(np.int32)) + count[at].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int32()), pa.array(keys, types[2]), pa.array(runs, types[3])], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size, last = [], [], 0, None
        for batch in batches:
            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if ident == last:  # rows come by id: a repeated one
                    continue
                last = ident
                text = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                ids.append(ident)
                found.append(anchors(text))
                size += len(text)
                if size >= RUN_BYTES:
                    yield from close(ids, found)
                    ids, found, size = [], [], 0
        yield from close(ids, found)

    return work


def _unpack_anchors(run: bytes) -> tuple[np.ndarray, ...]:
    n = struct.unpack_from("<q", run)[0]
    h = np.zeros((n, 8), dtype=np.uint8)
    h[:, :6] = np.frombuffer(run, np.uint8, 6 * n, 8).reshape(-1, 6)
    rest = _decompress(run[8 + 6 * n:])
    doc = np.cumsum(np.frombuffer(rest, np.int64, n), dtype=np.int64)
    pos = np.cumsum(np.frombuffer(rest, np.int32, n, 8 * n), dtype=np.int32)
    return h.view(np.uint64).ravel(), doc, pos, np.frombuffer(rest, np.uint32, n, 12 * n)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The runs of each part of rows (part, run) that come by part; one part is held at a time."""
    now, held = None, []
    for batch in batches:
        for p, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != now and held:
                yield held
                held = []
            now = p
            held.append(run.as_py())
    if held:
        yield held


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, pos) of anchors whose k-mer another run has too; (hash, count) of frequent k-mers."""
    names = ["doc_id", "pos", "hash", "count"]
    for held in _by_part(batches):
        h, doc, pos, count = (np.concatenate(x) for x in zip(*map(_unpack_anchors, held), strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, pos, count = h[order], doc[order], pos[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        runs, total = np.diff(np.append(first, len(h))), np.add.reduceat(count, first)
        # what a run holds more than once it has reported itself
        yes = (np.repeat(runs, runs) > 1) & (count == 1)
        k = int(yes.sum())
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(doc[yes]), pa.array(pos[yes]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
        many = total > HOT
        k = int(many.sum())
        if k:
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(h[first][many].astype(np.int64)), pa.array(total[many])], names)


def _spans(doc, start, end) -> list[pa.Array]:
    return [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]


def _suffix_runs(parts: int, hot: np.ndarray):
    """Front-coded sorted runs of suffixes; spans of suffixes that a run has before; strings of hot k-mers."""
    names = ["part", "run", "doc_id", "start", "stop", "h1", "h2"]

    def rows(n: int, part=None, run=None, doc=None, start=None, stop=None, h1=None, h2=None) -> pa.RecordBatch:
        types = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in zip((part, run, doc, start, stop, h1, h2), types, strict=True)], names)

    def close(ids: list[int], texts: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        buffer = np.concatenate([*texts, np.zeros(1, dtype=np.uint8)])
        base = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(ids)), [len(p) for p in places])
        doc, pos = np.array(ids, dtype=np.int64)[which], np.concatenate(places).astype(np.int64)
        left, right = np.minimum(pos, SIDE), np.minimum(sizes[which] - pos - KMER, SIDE)
        ok = left + right >= SIDE
        which, doc, pos, left, right = which[ok], doc[ok], pos[ok], left[ok], right[ok]
        if not len(doc):
            return
        step = np.concatenate((np.arange(KMER + SIDE), -1 - np.arange(SIDE))).astype(np.int32)
        at = (base[which] + pos).astype(np.int32)[:, None] + step[None, :]
        inside = np.concatenate((np.broadcast_to(np.arange(KMER + SIDE) < (KMER + right)[:, None], (len(doc), KMER + SIDE)), np.arange(SIDE) < left[:, None]), axis=1)
        at[~inside] = len(buffer) - 1  # a zero byte
        keys = buffer[at]
        del at, inside
        full = np.concatenate((keys, left.astype(np.uint8)[:, None], right.astype(np.uint8)[:, None]), axis=1)
        order = np.lexsort((pos, doc, *np.ascontiguousarray(np.pad(full, ((0, 0), (0, -full.shape[1] % 8)))).view(">u8").T[::-1]))
        full, keys, doc, pos, left, right = full[order], keys[order], doc[order], pos[order], left[order], right[order]
        again = np.concatenate(([False], (full[1:] == full[:-1]).all(axis=1)))
        if again.any():
            yield rows(int(again.sum()), doc=doc[again], start=pos[again] - left[again], stop=pos[again] + KMER + right[again])
        keys, doc, pos, left, right = keys[~again], doc[~again], pos[~again], left[~again], right[~again]
        h = window_hashes(np.ascontiguousarray(keys[:, :KMER]).ravel(), KMER)[::KMER]
        if len(hot):
            is_hot = np.isin(h & _U(0xFFFFFFFFFFFF), hot)
            for i in np.flatnonzero(is_hot):
                text = np.concatenate((keys[i, KMER + SIDE:KMER + SIDE + left[i]][::-1], keys[i, :KMER + right[i]]))
                starts = pos[i] - left[i] + np.arange(len(text) - LENGTH + 1)
                h1 = window_hashes(text, LENGTH)
                h2 = window_hashes(text ^ np.uint8(0x5A), LENGTH)
                yield rows(len(starts), doc=np.full(len(starts), doc[i]), start=starts, h1=h1.view(np.int64), h2=h2.view(np.int64))
            keys, doc, pos, left, right, h = (x[~is_hot] for x in (keys, doc, pos, left, right, h))
        part = ((h >> _U(48)) % _U(parts)).astype(np.int64)
        out_p, out_r = [], []
        for p in range(parts):
            i = np.flatnonzero(part == p)
            if not len(i):
                continue
            mine = keys[i]
            differ = mine[1:] != mine[:-1]
            shared = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
            shared = np.concatenate(([0], shared)).astype(np.uint8)
            tails = mine[np.arange(WIDTH)[None, :] >= shared[:, None]]
            body = shared.tobytes() + left[i].astype(np.uint8).tobytes() + right[i].astype(np.uint8).tobytes() + doc[i].tobytes() + pos[i].tobytes() + tails.tobytes()
            out_p.append(p)
            out_r.append(struct.pack("<q", len(i)) + _compress(body))
        if out_p:
            yield rows(len(out_p), part=out_p, run=out_r)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, places, size, last = [], [], [], 0, None
        for batch in batches:
            for ident, raw, pos in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if ident == last:
                    continue
                last = ident
                ids.append(ident)
                texts.append(np.frombuffer(raw.as_buffer(), dtype=np.uint8))
                places.append(np.unique(pos.values.to_numpy(zero_copy_only=False)))
                size += len(texts[-1]) + 100 * len(places[-1])
                if size >= SUFFIX_RUN_BYTES:
                    yield from close(ids, texts, places)
                    ids, texts, places, size = [], [], [], 0
            texts = [t.copy() for t in texts]  # the batch's memory goes
        if ids:
            yield from close(ids, texts, places)

    return work


Suffix = tuple[bytes, int, int, int, int]  # key, doc, pos, bytes before, bytes after


def read_run(run: bytes) -> Iterator[tuple[int, Suffix]]:
    """(common prefix with the suffix before it, suffix), in order."""
    n, body = struct.unpack_from("<q", run)[0], _decompress(run[8:])
    shared, left, right = body[:n], body[n:2 * n], body[2 * n:3 * n]
    doc, pos = np.frombuffer(body, np.int64, n, 3 * n).tolist(), np.frombuffer(body, np.int64, n, 11 * n).tolist()
    at, key = 19 * n, b""
    for i in range(n):
        take = WIDTH - shared[i]
        key = key[:shared[i]] + body[at:at + take]
        at += take
        yield shared[i], (key, doc[i], pos[i], left[i], right[i])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of keys that share ``known`` bytes."""
    while known < WIDTH:
        x, y = a[known:known + 16], b[known:known + 16]
        if x != y:
            diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return known + (8 * len(x) - diff.bit_length()) // 8
        known += 16
    return WIDTH


def merge_runs(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """Merges sorted runs; yields each suffix with its common prefix with the one before.

    The tree holds in each inner node the loser of a match.  Every stream knows the
    common prefix of its suffix with the last one that went out (the winner of all
    matches below it): of two streams the one with the longer prefix is less; only if
    the prefixes are equal are bytes compared, from there on.
    """
    streams = [iter(r) for r in runs]
    size = 1
    while size < len(streams):
        size *= 2
    head: list[Suffix | None] = [None] * size
    shared = [0] * size
    for i, s in enumerate(streams):
        head[i] = next(s, (0, None))[1]
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None or shared[a] > shared[b]:
            return a, b
        if shared[a] < shared[b]:
            return b, a
        n = common_prefix(x[0], y[0], shared[a])
        less = x[0][n] < y[0][n] if n < WIDTH else x[1:3] <= y[1:3]
        if less:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while head[winner] is not None:
        yield shared[winner], head[winner]
        step = next(streams[winner], None)
        if step is None:
            head[winner] = None
        else:
            shared[winner], head[winner] = step  # the run's own prefix: its last suffix just went out
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated(group: list[Suffix], shared: list[int]) -> list[tuple[int, int, int]]:
    """(doc, start, stop) of what each suffix of one k-mer shares, as strings of ``LENGTH`` bytes, with an earlier one.

    ``shared[i]`` is the prefix that the merge knows suffix i to share with the one
    before it.  The least of these between two suffixes is what they share after the
    k-mer; if they share all of that side, it goes on into the bytes before it, which
    otherwise are met in order of their own, so that nothing known is compared again.
    """
    n, reach = len(group), KMER + SIDE
    out = []
    if n <= 8:
        for i in range(n):
            least = WIDTH
            for j in range(i + 1, n):
                least = min(least, shared[j])
                a, b = group[i], group[j]
                after = min(least - KMER, SIDE, a[4], b[4])
                if after + min(a[3], b[3]) < SIDE:
                    continue
                before = least - reach if least >= reach else _tail_prefix(a[0][reach:], b[0][reach:])
                before = min(before, a[3], b[3])
                if before + after >= SIDE:
                    _, doc, pos, _, _ = max(a, b, key=lambda s: s[1:3])
                    out.append((doc, pos - before, pos + KMER + after))
        return out
    # classes of equal bytes: after the k-mer by the merge's prefixes, before it by those of a sorted order of their own
    tails = [s[0][reach:] for s in group]
    order = sorted(range(n), key=tails.__getitem__)
    prior = [0] + [_tail_prefix(tails[a], tails[b]) for a, b in zip(order, order[1:])]  # noqa: B905
    right_known, left_known = np.array(shared), np.array(prior)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    age = np.lexsort(([s[2] for s in group], [s[1] for s in group]))  # earliest first
    rank = np.empty(n, dtype=np.int64)
    rank[age] = np.arange(n)
    left, right = np.array([s[3] for s in group]), np.array([s[4] for s in group])
    for o in range(SIDE + 1):
        ok = (left >= o) & (right >= SIDE - o)
        if ok.sum() < 2:
            continue
        after = np.cumsum(right_known < KMER + SIDE - o)
        before = np.cumsum(left_known < o)[place]
        code = after * (n + 1) + before
        valid = np.flatnonzero(ok)
        valid = valid[np.argsort(rank[valid], kind="stable")]
        _, first = np.unique(code[valid], return_index=True)
        again = np.ones(len(valid), dtype=bool)
        again[first] = False
        for i in valid[again]:
            _, doc, pos, _, _ = group[i]
            out.append((doc, pos - o, pos - o + LENGTH))
    return out


def _tail_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of the bytes before two k-mers."""
    diff = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return (8 * len(a) - diff.bit_length()) // 8


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[tuple[int, int]]] = {}
    n = 0

    def flush() -> pa.RecordBatch:
        merged = [(d, s, e) for d, spans in found.items() for s, e in join_spans(spans)]
        found.clear()
        return pa.RecordBatch.from_arrays(_spans(*zip(*merged, strict=True)), ["doc_id", "start", "stop"])

    for held in _by_part(batches):
        group: list[Suffix] = []
        known: list[int] = []
        for shared, suffix in merge_runs([read_run(r) for r in held]):
            if shared < KMER and group:
                if len(group) > 1:
                    for d, s, e in repeated(group, known):
                        found.setdefault(d, []).append((s, e))
                        n += 1
                group, known = [], []
            group.append(suffix)
            known.append(shared)
            if n > 200_000:
                yield flush()
                n = 0
        if len(group) > 1:
            for d, s, e in repeated(group, known):
                found.setdefault(d, []).append((s, e))
                n += 1
    if found:
        yield flush()


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for ident, raw, copy, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = raw.as_py()
                gone = [(0, len(raw))] if copy and len(raw) >= LENGTH else join_spans([(x["start"], x["stop"]) for x in spans or []])
                parts, at = [], 0
                for s, e in gone:
                    parts.append(raw[at:s])
                    at = e
                kept = b"".join([*parts, raw[at:]])
                row = (ident, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *[kept] * with_text)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return work


def remove_repeats(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``) for every row of ``docs``.

    A null text is empty; texts below ``LENGTH`` bytes keep all.  Rows that repeat an
    id and its text are one document and get the same result.  A null id counts as
    less than any other.  If an id has several texts, the one of least SHA-256 is the
    document's; the others are kept whole and nothing is held against them.  Other
    columns play no part; an empty table gives none.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "dedup")
    parts = parts_for(spark, text_bytes(docs))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    texts = docs.select("doc_id", key.alias("id"), utf8(F.col("text")).alias("raw")).withColumn("print", F.sha2("raw", 256))
    # bucketed and sorted by id: the merge joins with narrow tables below, on id alone, don't move the texts again
    name = f"driftloom_texts_{uuid.uuid4().hex}"
    atexit.register(drop_table, spark, name)
    with settings(spark, {FREE_SHUFFLES: "true"}):
        buckets = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        texts.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", tables.path("texts")).saveAsTable(name)
    table = spark.table(name)
    prints = table.select("id", "print", (F.length("raw") >= LENGTH).alias("long")).groupBy("id").agg(F.min("print").alias("own"), F.max("long").alias("long"))
    prints = tables.keep(prints, "prints")
    least = tables.keep(prints.groupBy("own").agg(F.min("id").alias("first"), F.count("*").alias("n")), "least")
    prints = tables.keep(join_hot(prints, least, "own").withColumn("copy", F.col("id") != F.col("first")).select("id", "own", "copy", "long"), "copies")
    first = table.join(prints.filter("not copy and long").select("id", "own").hint("merge"), "id").filter("print <= own").select("id", "raw")  # own is the least; an equality would become a join key and move the texts

    def by_part(runs: DataFrame) -> DataFrame:
        return runs.filter("run is not null").select("part", "run").repartition(parts, "part").sortWithinPartitions("part")

    runs = tables.keep(first.mapInArrow(_anchor_runs(parts), "doc_id long, pos int, part int, run binary"), "anchors")
    met = tables.keep(by_part(runs).mapInArrow(_candidates, "doc_id long, pos int, hash long, count long"), "candidates")
    frequent = met.filter("hash is not null").orderBy(F.desc("count")).limit(HOT_SHARE).select("hash").collect()  # a bounded list
    hot = np.array([r["hash"] for r in frequent], dtype=np.int64).view(np.uint64)
    found = met.filter("doc_id is not null").select("doc_id", "pos").unionByName(runs.filter("doc_id is not null").select("doc_id", "pos"))
    places = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("pos").alias("pos"))  # at most one for each byte of the text

    pieces = first.join(places.hint("merge"), "id").select("id", "raw", "pos").mapInArrow(_suffix_runs(parts, hot), "part int, run binary, doc_id long, start int, stop int, h1 long, h2 long")
    pieces = tables.keep(pieces, "suffixes")
    tables.drop("anchors", "candidates")
    spans = pieces.filter("stop is not null").select("doc_id", "start", "stop")
    spans = spans.unionByName(by_part(pieces).mapInArrow(_merge, "doc_id long, start int, stop int"))
    if len(hot):
        strings = pieces.filter("h1 is not null").select("h1", "h2", "doc_id", "start")
        one = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("one"), F.count("*").alias("n")).filter("n > 1")
        met_again = join_hot(strings, tables.keep(one, "first-strings"), ["h1", "h2"])
        spans = spans.unionByName(met_again.filter(F.struct("doc_id", "start") > F.col("one")).select("doc_id", "start", (F.col("start") + LENGTH).alias("stop")))
    spans = tables.keep(spans.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    tables.drop("suffixes")
    last = table.join(prints.join(spans, "id", "left").select("id", "own", "copy", "spans").hint("merge"), "id")
    same = F.col("print") == F.col("own")
    last = last.select("doc_id", "raw", (same & F.col("copy")).alias("copy"), F.when(same, F.col("spans")).alias("spans"))
    return last.mapInArrow(_cut(with_text), RESULT if with_text else RESULT.replace(", kept binary", ""))

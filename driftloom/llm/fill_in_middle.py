"""Fill-in-the-middle transformation by a table-driven automaton over bytes.

A text is cut into units (white space and the word after it; white space at the end is
a unit of its own), and for a seeded share of the documents the units are rearranged as
prefix, suffix and middle behind sentinels.

*One scan.*  The automaton's state knows whether it stands in white space or a word, how
many UTF-8 continuation bytes are due, and how much of a sentinel it has seen.  A table
of (state, byte) gives the next state and what the transition emits: a unit has ended
before this byte, a code point begins, a sentinel is complete.  Emitted transitions are
counted per lane of ``LANE`` bytes.  Lanes are run side by side: whatever the state was,
``MEMORY`` bytes later it is known (``memory`` derives that from the table), so a lane
starts a few bytes early and needs nothing of the lane before it.

*Second pass.*  The counts tell the lane in which a cut lies, and only that lane is run
again to find the byte.

Null is an empty text.  Empty texts and texts that hold a sentinel stay plain, whatever
the draw.  A null id draws as the empty string; rows that repeat an id draw alike.  Texts
of any length count whole; memory follows the longest text of a batch, once.  Other
columns play no part, and an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

SENTINELS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = SENTINELS

#: States: in white space (also the start), in a word, after "<", after "<" and a letter of a
#: sentinel, and in a character of which so many bytes are still due.
SPACE, WORD, OPENED, LETTER, DUE1, DUE2, DUE3 = range(7)
STATES = 7
#: What a transition emits, as bits.
UNIT, POINT, SENTINEL = 1, 2, 4

LANE = 512
#: Bytes of text that are run at a time, about; a longer text is run in parts.
BLOCK = 4 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted bits), indexed by state * 256 + byte."""
    after, emits = np.zeros((STATES, 256), np.uint8), np.zeros((STATES, 256), np.uint8)
    letters = {s[1] for s in SENTINELS}
    for state in range(STATES):
        for byte in range(256):
            if 0x80 <= byte < 0xC0:  # a stray continuation byte counts as part of a word
                after[state, byte] = state - 1 if state in (DUE2, DUE3) else WORD
                continue
            emits[state, byte] = POINT
            if byte == 0x20 or 0x09 <= byte <= 0x0D:
                after[state, byte] = SPACE
                emits[state, byte] |= UNIT if state != SPACE else 0
            elif byte >= 0xC0:
                after[state, byte] = DUE1 if byte < 0xE0 else DUE2 if byte < 0xF0 else DUE3
            elif byte == ord("<"):
                after[state, byte] = OPENED
            elif state == OPENED and byte in letters:
                after[state, byte] = LETTER
            else:
                after[state, byte] = WORD
                emits[state, byte] |= SENTINEL if state == LETTER and byte == ord(">") else 0
    return after.ravel(), emits.ravel()


NEXT, EMITS = _tables()


def memory() -> int:
    """Bytes after which the state no longer depends on the one before them."""
    table = NEXT.reshape(STATES, 256)
    images, n = {frozenset(range(STATES))}, 0
    while any(len(s) > 1 for s in images):
        images = {frozenset(int(table[s, b]) for s in states) for states in images if len(states) > 1 for b in range(256)}
        n += 1
        if n > STATES * STATES:
            raise ValueError("the automaton never forgets its start")
    return n


MEMORY = memory()


class Scan:
    """The lanes of some texts that lie in one buffer, and what each of them emitted."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.raw, self.lengths = raw, lengths
        per_text = -(-lengths // LANE)
        self.first = np.concatenate(([0], np.cumsum(per_text)))  # first lane of each text
        text = np.repeat(np.arange(len(starts)), per_text)
        nth = np.arange(self.first[-1]) - self.first[text]
        self.offset = nth * LANE
        self.begin = starts[text] + self.offset
        self.size = np.minimum(LANE, lengths[text] - self.offset)
        self.text_start = starts[text]
        self.units, self.points, self.sentinels = (np.zeros(len(text), np.int64) for _ in range(3))
        step = max(1, BLOCK // LANE)
        for at in range(0, len(text), step):
            lanes = np.arange(at, min(at + step, len(text)))
            for _, live, emitted in self._steps(lanes):
                self.units[live] += emitted & UNIT
                self.points[live] += (emitted & POINT) >> 1
                self.sentinels[live] += (emitted & SENTINEL) >> 2

    def _steps(self, lanes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, lanes of more than k bytes, what their k-th byte emits) for every k."""
        lanes = lanes[np.argsort(-self.size[lanes], kind="stable")]
        state = np.zeros(len(lanes), np.intp)
        begin, low = self.begin[lanes], self.text_start[lanes]
        for k in range(-MEMORY, 0):  # before the text's start the state stays SPACE
            at = begin + k
            known = at >= low
            state[known] = NEXT[(state[known] << 8) | self.raw[at[known]]]
        count = np.searchsorted(-self.size[lanes], -np.arange(LANE), side="left")  # lanes longer than k
        for k in range(LANE):
            n = count[k]
            if not n:
                return
            index = (state[:n] << 8) | self.raw[begin[:n] + k]
            state[:n] = NEXT[index]
            yield k, lanes[:n], EMITS[index]

    def totals(self, of: np.ndarray) -> np.ndarray:
        """A count of lanes summed for each text."""
        sums = np.concatenate(([0], np.cumsum(of)))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def cuts(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code point) at which the given number of units ends, in each of the given texts.

        The number lies strictly between 0 and the text's units: the end of its last
        unit is the end of the text and no transition.
        """
        ends = np.cumsum(self.units)
        before = np.concatenate(([0], ends))
        wanted = before[self.first[texts]] + units
        lane = np.searchsorted(ends, wanted)
        points_before = np.concatenate(([0], np.cumsum(self.points)))
        left = wanted - before[lane]
        place, points = np.full(len(texts), -1, np.int64), points_before[lane] - points_before[self.first[texts]]
        step = max(1, BLOCK // LANE)
        for at in range(0, len(texts), step):  # lanes of so many cuts at a time; a lane may hold several
            mine = slice(at, at + step)
            run, which = np.unique(lane[mine], return_inverse=True)
            emitted = np.zeros((len(run), LANE), np.uint8)
            for k, live, out in self._steps(run):
                emitted[np.searchsorted(run, live), k] = out
            rows = emitted[which]
            found = (np.cumsum(rows & UNIT, axis=1) == left[mine, None]).argmax(axis=1)
            place[mine] = self.offset[lane[mine]] + found
            points[mine] += np.count_nonzero((rows & POINT) * (np.arange(LANE)[None, :] < found[:, None]), axis=1)
        return place, points


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four seeded 32-bit numbers for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))


def _arrange(ids: list, texts: pa.Array, seed: int, rate: int, spm: int) -> dict[str, list]:
    """The output columns of some texts (binary, no nulls)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    scan = Scan(raw, offsets[:-1], lengths)
    n = scan.totals(scan.units) + (lengths > 0)
    chars = scan.totals(scan.points)
    h = np.array([draws(x, seed) for x in ids], np.int64).reshape(-1, 4)
    plain = (lengths == 0) | (scan.totals(scan.sentinels) > 0) | (h[:, 2] % 100 >= rate)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    cut_bytes, cut_chars = [], []
    for count in (first, second):
        at_byte, at_char = np.where(count >= n, lengths, 0), np.where(count >= n, chars, 0)
        inner = np.flatnonzero((count > 0) & (count < n) & ~plain)
        at_byte[inner], at_char[inner] = scan.cuts(inner, count[inner])
        cut_bytes.append(at_byte)
        cut_chars.append(at_char)
    form, output = [], []
    whole = memoryview(data) if data is not None else memoryview(b"")
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if plain[i]:
            form.append("plain")
            output.append(bytes(whole[a:b]))
            continue
        prefix, middle, suffix = whole[a:a + cut_bytes[0][i]], whole[a + cut_bytes[0][i]:a + cut_bytes[1][i]], whole[a + cut_bytes[1][i]:b]
        if h[i, 3] % 100 < spm:
            form.append("spm")
            output.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
        else:
            form.append("psm")
            output.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    numbers = lambda x: pa.array(x, pa.int64(), mask=plain)
    return {"n": pa.array(n, pa.int64()), "form": form, "prefix_chars": numbers(cut_chars[0]), "middle_chars": numbers(cut_chars[1] - cut_chars[0]), "output": output}


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n (units), form, prefix_chars, middle_chars and output.

    ``rate`` per cent of the texts are rearranged, ``spm`` per cent of these with the
    suffix first.  No exchange takes place.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # slices of about BLOCK bytes, or one longer text
                stop, held = at, 0
                while stop < batch.num_rows and (stop == at or held + len(batch.column(1)[stop].as_buffer()) <= BLOCK):
                    held += len(batch.column(1)[stop].as_buffer())
                    stop += 1
                part = batch.slice(at, stop - at)
                out = _arrange(part.column(0).to_pylist(), part.column(1), seed, rate, spm)
                output = pa.array(out.pop("output"), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), out["n"], pa.array(out["form"], pa.string()), out["prefix_chars"], out["middle_chars"], output],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                at = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("raw")).mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: pieces hold no sentinel, so the three split it without doubt."""
    piece = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output))


def digests(arranged: DataFrame) -> DataFrame:
    """``fill_in_middle`` with SHA-256 of the output and of the text rebuilt from it in place of the output."""
    return arranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                           F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS pick, ('0x' || h[25:32])::BIGINT % 100 AS turn FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR pick >= 50 THEN 'plain' WHEN turn < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""

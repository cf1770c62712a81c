"""Ranked search, fill-in-the-middle and SimHash classes against brute force, and their odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.llm import fill_in_middle as M
from driftloom.llm import lexical_search as X
from driftloom.llm import simhash as S
from driftloom.llm.common import pieces

ODD = "doc_id long, text string, term string, segment string, fp string, rep string, label string, form string, output string, item string, score string, n string"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_rows(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcéß漢") for _ in range(rng.randint(1, 3)))
    prose = lambda n: rng.choice(" \n").join(word() for _ in range(n))
    texts = [None, "", " \t\n", "x", "<P> y", "a<S>b c", "a < b <P", prose(20_000), "z" * 30_000, "漢" * 2_000, "one two", *[prose(rng.randint(1, 60)) for _ in range(60)]]
    data = [(i, t) for i, t in enumerate(texts)]
    return data + [(11, texts[11]), (200, texts[11]), (None, texts[12]), (None, None), (13, texts[14]), (201, texts[13] + " end")]


def frame(spark, data):
    return spark.createDataFrame([(d, t, *["c"] * 10) for d, t in data], ODD).repartition(3)


# fill in the middle


def plain_form(doc_id, text, seed=42):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_automaton_forgets_its_start():
    table = M.NEXT.reshape(M.STATES, 256)
    kinds = [ord(c) for c in " <P>a"] + [0x80, 0xC3, 0xE6, 0xF0]
    for word in product(kinds, repeat=M.MEMORY):
        ends = set()
        for s in range(M.STATES):
            for b in word:
                s = int(table[s, b])
            ends.add(s)
        assert len(ends) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("<PSM> \n\x0bab é漢😀"), max_size=1300), min_size=1, max_size=6))
def test_scan_equals_the_regular_expression(texts):
    out = M._arrange(list(range(len(texts))), pa.array([t.encode() for t in texts], pa.binary()), 42, 50, 80)
    for i, t in enumerate(texts):
        assert (out["n"][i].as_py(), out["form"][i], out["prefix_chars"][i].as_py(), out["middle_chars"][i].as_py(), out["output"][i].decode()) == plain_form(i, t)


def test_fill_in_middle_of_odd_rows(spark):
    data = odd_rows()
    arranged = M.fill_in_middle(frame(spark, data))
    got = arranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", M.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((d, *plain_form(d, t), t or "") for d, t in data), key=key)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert M.digests(M.fill_in_middle(frame(spark, data[:0]))).count() == 0


def test_every_form_can_be_undone(spark):
    data = [(i, t) for i, (_, t) in enumerate(odd_rows(3) * 3)]
    for rate, spm in ((100, 0), (100, 100), (0, 50)):
        out = M.fill_in_middle(frame(spark, data), rate=rate, spm=spm)
        back = {r["doc_id"]: r["t"] for r in out.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("t")).collect()}
        assert back == {d: t or "" for d, t in data}


# ranked search


def by_hand(data, items, k=20):
    held = [(d, Counter(TERMS.findall((t or "").translate(LOWER)))) for d, t in data]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in {*items}:
        asked = Counter(TERMS.findall((text or "").translate(LOWER)))
        scores = []
        for (d, c), size in zip(held, sizes):
            m = 75 + 25 * size * n // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


ITEMS = [(0, None), (1, ""), (2, "A ab c éa"), (2, "ab"), (3, "a b c a A ab 漢 漢é ß"), (None, "b c"), (5, "absent"), (6, "x one two"), (6, "x one two")]


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scores_by_hand(spark, monkeypatch, small):
    if small:  # many segments, blocks of items and slices of a segment's items
        for name, value in (("SEGMENT_BYTES", 400), ("SEGMENT_DOCS", 3), ("ITEM_ROWS", 9), ("CELLS", 4)):
            monkeypatch.setattr(X, name, value)
    data = odd_rows(1)
    items = spark.createDataFrame([(i, t, "c") for i, t in ITEMS], "item_id long, text string, doc_id string")
    for k in (20, 3):
        got = [tuple(r) for r in X.rank_documents(frame(spark, data), items, k=k).collect()]
        assert sorted(got, key=lambda r: tuple((x is None, x) for x in r)) == by_hand(data, ITEMS, k)
    assert X.rank_documents(frame(spark, data[:0]), items).count() == 0
    assert X.rank_documents(frame(spark, data), items.limit(0)).count() == 0


def test_copies_all_pass_the_bound(spark):
    data = [(i, "oak elm" if i % 2 else "oak fir fir") for i in range(500)] + [(500, None)]
    items = [(1, "oak elm"), (2, "fir")]
    got = X.rank_documents(frame(spark, data), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == by_hand(data, items)


def test_bounds_hold_for_every_impact():
    tf, m = np.meshgrid(np.array([1, 2, 3, 10, 1000, 10**6]), np.array([75, 76, 100, 5000, 10**7, 10**11]))
    x = X.impact(tf.ravel().astype(np.int64), m.ravel().astype(np.int64))
    level = -(-x // X.STEP)
    assert level.max() <= 255 and (x <= level * X.STEP).all() and (x[level > 0] >= (level[level > 0] - 1) * X.STEP + 1).all() and (x[level == 0] == 0).all()


def test_pieces_keep_words_whole():
    raw = b"aa b ccc  dddddddddd e " * 20
    for size in (1, 3, 7, 1000):
        parts = list(pieces(raw, rb" ", size))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


# SimHash


def plain_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints):
    up = {d: d for d in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {d: top(d) for d in prints}


def test_nearby_codewords_meet():
    check, error, _ = S.golay()
    words = (np.arange(1 << 12) << 11) | check
    assert np.bitwise_count(words[1:]).min() == 7 and np.count_nonzero(error) == 2047  # distance 7, every syndrome corrected
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 23, 4000)
    near = S.nearby(x)
    for s, row in zip(x[:300], near[:300]):
        assert {int(c) for c in row if c >= 0} == set(np.flatnonzero(np.bitwise_count(words ^ s) <= 4).tolist())
    for flips in range(3):
        y = x.copy()
        for _ in range(flips):
            y ^= 1 << rng.integers(0, 23, len(y))
        assert all({*a[a >= 0]} & {*b[b >= 0]} for a, b in zip(near, S.nearby(y)))


def test_placements_cover_all_errors():
    for errors in product(range(3), repeat=3):
        if sum(errors) <= S.ERRORS:
            assert any(errors[whole] == 0 and errors[nxt] <= 1 for whole, nxt in S.PLACEMENTS)
    for whole in range(3):
        runs = S.free_pieces(whole << 40)
        assert sum(map(len, runs)) == 64 - S.SEGMENTS[whole][1] and sum(sorted(map(len, runs))[-2:]) <= 18


def test_groups_agree():
    rng = np.random.default_rng(5)
    for density in (100, 900, 4000):
        fp = np.unique(rng.integers(0, 2**16, density, dtype=np.uint64))
        want = plain_classes({i: int(x) for i, x in enumerate(fp)}) if density < 1000 else None
        pairs, looked = S.groups_by_pairs(fp), S.groups_by_lookup(fp, list(range(16)))
        assert (pairs == looked).all() and (want is None or list(pairs) == list(want.values()))


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_classes_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)  # 3: nearly every bucket with links is dealt by its pieces
    rng = random.Random(6)
    base = [" ".join(rng.choice("oak elm fir ash yew") + str(rng.randrange(9)) for _ in range(150)) for _ in range(4)]
    data = [(i, t) for i, t in enumerate([None, "", " ", "a", "A", "a b", "a b c", *base])]
    for i in range(200):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        data.append((1000 - i, " ".join(words)))
    want = plain_classes({d: plain_print(t) for d, t in data})
    assert len(set(want.values())) < len(want) - 50
    got = S.link_classes(frame(spark, data)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == {d: plain_print(t) for d, t in data}


def test_simhash_of_odd_rows(spark):
    data = odd_rows()
    got = S.link_classes(frame(spark, data)).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, f"{plain_print(t):016x}") for d, t in data)
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in got)
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16 and r["doc_id"] is not None} == {0}
    assert S.link_classes(frame(spark, data[:0])).count() == 0
    long = " ".join(f"w{i % 977}" for i in range(900_000)).encode()
    assert len(long) > 4 << 20 and S.fingerprint(long) == plain_print(long.decode())

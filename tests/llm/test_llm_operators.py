"""Edge cases of every operator, and brute-force versions on small tables."""

import hashlib
import json
import re
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import components as C
from driftloom.llm import decontaminate as DC
from driftloom.llm import jaccard_join as J
from driftloom.llm import licenses as L
from driftloom.llm import mixing as M
from driftloom.llm import order_minhash as O
from driftloom.llm import pii as P
from driftloom.llm import sharding as S
from driftloom.llm import suffix_dedup as D
from driftloom.llm import toxicity as T
from driftloom.llm import warc as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, topic string, row string, position string, id string, raw string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1, n=40):
    """Rows with copies, near copies, shared passages, nulls, empties and a very long text."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [texts[3], texts[3], texts[4] + " more", "", None, " \t\n", "one two", "one  two", words(rng, 20000)]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 30) for _ in range(12)]
    base = words(rng, 100).split()
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        texts.append(" ".join(copy))
    rows = [(i * 3 % 1000, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, la, so, 0, "x", "y", "z", "p", "q", "r") for d, t, la, so in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# components


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    found = {r.node: r.label for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(31)) and all(found[x] == 100 for x in range(100, 140))
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def least_of(edges):
    """Union-find: the least node that each node reaches."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in list(up)}


def shuffled_edges(seed, sizes, tree):
    """Paths or trees over ids in random order."""
    rng = random.Random(seed)
    ids, edges = rng.sample(range(1000), sum(sizes)), []
    for n in sizes:
        part, ids = ids[:n], ids[n:]
        edges += [(part[i], part[rng.randrange(i) if tree else i - 1]) for i in range(1, n)]
    return edges


@pytest.mark.parametrize("edges", [[(1, 3), (3, 4), (4, 6), (6, 2)], shuffled_edges(1, [6, 10], False), shuffled_edges(2, [6, 7, 8], True), shuffled_edges(3, [40], True)])
def test_components_equal_union_find(spark, edges):
    rows = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.label for r in rows} == least_of(edges)


# 1


def brute_components(rows, k, num, den):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("leaf", "cell"), [(1024, 8192), (4, 6)])
@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 8, 10)])
def test_jaccard_join_is_exact(spark, monkeypatch, leaf, cell, k, num, den):
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "CELL", cell)
    rows = corpus()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_classes(frame(spark, rows), words=k, num=num, den=den).collect()}
    assert found == brute_components(rows, k, num, den)


def test_texts_that_share_a_line_make_no_region(spark, monkeypatch):
    monkeypatch.setattr(J, "LEAF", 8)
    monkeypatch.setattr(J, "SIEVE_ROWS", 5)  # a pivot's members are several blocks
    monkeypatch.setattr(J, "_block_tasks", lambda *a: pytest.fail("texts that only share a line are one region"))
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + " one line of them all", "en", "a") for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more", "en", "a") for i in range(0, 300, 40)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_classes(frame(spark, rows)).collect()}
    assert found == brute_components(rows, 5, 8, 10) and len({c for _, c in found.values()}) == 300


def test_sieve_in_blocks_keeps_every_link(spark, monkeypatch):
    monkeypatch.setattr(J, "LEAF", 4)
    monkeypatch.setattr(J, "SIEVE_ROWS", 3)
    rows = corpus()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join_classes(frame(spark, rows)).collect()}
    assert found == brute_components(rows, 5, 8, 10)
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1000, 1500, 1500)]
    sets += [s[5:] for s in sets]
    sketches, sizes = [J.parity_sketch(s) for s in sets], np.array([len(s) for s in sets])
    assert len({len(s) for s in sketches}) == 2
    assert sorted(tuple(sorted(e)) for e in J.sieve_forest(sketches, sizes, 8, 10, 3)) == [(0, 3), (1, 4), (2, 5)]
    assert J.sieve_forest(sketches, sizes, 8, 10, 5) == [(2, 5)] or J.sieve_forest(sketches, sizes, 8, 10, 5) == [(5, 2)]


def test_jaccard_join_edges(spark):
    assert J.join_classes(empty(spark)).count() == 0
    rows = [(None, "a b c", "en", "s"), (5, "a b c", "en", "s"), (5, "a b c", "en", "s"), (9, "A B  C", "en", "s"), (2, None, "en", "s"), (1, "", "en", "s")]
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in J.join_classes(frame(spark, rows)).collect())
    assert found == [("1", 0, 1), ("2", 0, 2), ("5", 1, 5), ("5", 1, 5), ("9", 1, 5), ("None", 1, None)]
    kept = J.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "None"]


def test_one_part_of_linked_sets_is_whole():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 6, 7, 13, 40, 129, 700):
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            edits = 15 * n // 85
            gone, new = (e := rng.integers(0, edits + 1)), edits - e
            b = np.concatenate((a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)))
            both = n - gone
            if 100 * both >= 85 * (n + len(b) - both) and len(b):
                assert set(J.signatures(np.sort(a), 85, 100)) & set(J.signatures(np.sort(b), 85, 100))


# 2


def test_licences_and_inheritance(spark):
    rows = [("a/LICENSE", "Some words.\nReleased under the MIT License."), ("a/b/c/f.py", "x = 1"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            ("a/b/g.py", "Licensed under CC BY-NC 4.0.\ncode"), ("a/h.py", "nothing " * 9), ("z/h.py", "no licence here at all"), ("LICENSE2", None), (None, "Released under the MIT License."), ("e.txt", "")]
    files = spark.createDataFrame(rows, "path string, text string")
    out = {r.path: (r.licence, r.inherited_from) for r in L.inherit(files, L.scan(files)).collect()}
    assert out["a/LICENSE"] == ("MIT", None) and out["a/b/c/f.py"] == ("GPL-3.0", "a/b") and out["a/b/g.py"] == ("CC-BY-NC-4.0", None)
    assert out["a/h.py"] == ("MIT", "a") and out["z/h.py"] == ("unknown", None) and out["LICENSE2"] == out["e.txt"] == out[None] == ("unknown", None)
    none = spark.createDataFrame([], "path string, text string")
    assert L.inherit(none, L.scan(none)).count() == 0


# 3


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_repeats_are_removed_exactly(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    rng = random.Random(5)
    rows = corpus(7)
    line = words(rng, 12)  # shorter than a string, and frequent
    rows += [(2000 + i, words(rng, 5) + line + words(rng, 5), "en", "s") for i in range(20)]
    rows += [(3000, "ab" * 300, "en", "s"), (3001, "é" * 90 + "x" + "é" * 90, "en", "s"), (3002, "\0" * 250 + "tail", "en", "s")]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.remove_repeats(frame(spark, rows)).collect()}
    assert found == brute_repeats(rows, D.LENGTH)


def test_repeats_edges(spark):
    assert D.remove_repeats(empty(spark)).count() == 0
    text = "x" * 30 + "".join(chr(97 + i % 26) for i in range(300))
    rows = [(4, text, "en", "s"), (4, text, "en", "s"), (None, None, "en", "s")]
    out = D.remove_repeats(frame(spark, rows), with_text=True).collect()
    assert len(out) == 3 and out[[r.doc_id for r in out].index(4)].n_removed == [r.n_removed for r in out if r.doc_id == 4][1]


def test_loser_tree_merges_with_known_prefixes():
    rng = random.Random(3)
    runs, every = [], []
    for _ in range(7):
        run = sorted((bytes(rng.choice(b"ab") for _ in range(D.WIDTH)), rng.randrange(99), rng.randrange(99), 60, 60) for _ in range(rng.randrange(30)))
        every += run
        runs.append([(D.common_prefix(run[i - 1][0], s[0]) if i else 0, s) for i, s in enumerate(run)])
    merged = list(D.merge_runs([iter(r) for r in runs]))
    assert [s for _, s in merged] == sorted(every)
    assert all(n == D.common_prefix(a[0], b[0]) for (_, a), (n, b) in zip(merged, merged[1:]))


# 4


def test_warc_round_trip(spark):
    pages = [(1, "u", "<a>"), (2, "v", "<a>"), (3, None, None), (4, "w", ""), (5, "x", "y" * 100_000), (None, "n", "z"), (7, "u", "é\r\n\r\n")] + [(100 + i, "p", f"<p>{i} {'word ' * 50}") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r for r in W.round_trip(df).collect()}
    assert len(out) == len(pages)
    assert (out[1].record_type, out[1].refers_to, out[2].record_type, out[3].refers_to) == ("revisit", 2, "response", 4)
    for p, _, h in pages:
        raw = (h or "").encode()
        assert (out[p].payload_bytes, out[p].payload_digest) == (len(raw), W.digest32(raw))
    assert W.round_trip(df.limit(0)).count() == 0


def test_warc_reader_validates():
    record = W.encode_record(1, "u", b"payload", None, False)
    assert W.decode_record(record)["payload"] == b"payload"
    for bad in (record[:-1], record.replace(b"payload", b"paYload"), record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"WARC-Date", b"Date"), record.replace(b"Content-Length: 8", b"Content-Length: x")):
        with pytest.raises(ValueError):
            W.decode_record(bad)
    many = [W.encode_record(i, "u", f"{i} payload {'text ' * 200}".encode(), None, False) for i in range(300)]
    archive = W.pack_archive(many)
    assert archive[:4] == b"\x5d\x2a\x4d\x18" and list(W.unpack_archive(archive)) == many
    for cut in (archive[:-3], archive[:6], b"junkjunk" + archive):
        with pytest.raises(ValueError):
            list(W.unpack_archive(cut))


# 5


def test_surrogates_keep_format_and_distinctness(spark):
    k = P.Keyed(b"k")
    text = "mail jo.81@mail3.example.com or JO.81@mail3.example.com, call +1 (017) 555-7713, card 4532 0151 1283 0366, no card 4532015112830367, ip 83.229.25.121 v 1.2.3.4, token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\", Frau Anna Weber and Mr. Peter Smith"
    clean, log = P.replace(text, k.surrogate)
    kinds = [x[0] for x in log]
    assert kinds == ["email", "email", "phone", "card", "ip", "secret", "person", "person"]
    assert "4532015112830367" in clean and "1.2.3.4" in clean and clean.startswith("mail ")
    by = {x[2]: x[3] for x in log}
    assert by["JO.81@mail3.example.com"].lower() == by["jo.81@mail3.example.com"].lower() and all(a != b for a, b in by.items())
    card = re.sub(r"\D", "", by["4532 0151 1283 0366"])
    assert P.luhn(card[:-1]) == int(card[-1]) and by["Anna Weber"].split()[0] in P.GIVEN["latin", "f"] and by["Peter Smith"].split()[0] in P.GIVEN["latin", "m"]
    many = {k.surrogate("phone", f"+1 (555) 010-{i:04d}") for i in range(10_000)}
    assert len(many) == 10_000 and len({k.name(n, P.FAMILY["latin"], "family") for n in [*P.FAMILY["latin"], "Xy", "Quux"]}) == len(P.FAMILY["latin"]) + 2
    docs = frame(spark, [(1, text, "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (3, text, "en", "s")])
    out = P.pseudonymize(docs, b"k").collect()
    assert sorted((r.doc_id, r.clean_text or "", len(r.entities)) for r in out) == [(1, clean, 8), (2, "", 0), (3, "", 0), (3, clean, 8)]
    assert P.pseudonymize(empty(spark), b"k").count() == 0


# 6


def test_shards_interleave_sources(spark):
    rows = [(i, f"t{i % 50}", "en", "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(5000)] + [(None, None, None, None), (1, "t1", "en", "s1"), (1, "t1", "en", "s1")]
    out = S.shard_documents(frame(spark, rows)).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == len(rows) and counts.max() - counts.min() <= 1 and sorted(out.position) == list(range(len(rows)))
    assert out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    share = out.fillna({"source": "-"}).groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (share.max() - share.min()).max() <= 3
    assert out[out.doc_id == 7].text_crc32.iloc[0] == zlib.crc32(b"t7") and out[out["size"] == 8].shape[0] == 1
    assert S.shard_documents(empty(spark)).count() == 0 and S.shard_documents(frame(spark, rows[:3])).count() == 3


# 7


def test_order_minhash_neighbours(spark):
    rows = corpus(9)
    out = {r.doc_id: r for r in O.against_next(frame(spark, rows)).collect()}
    ids = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    for i, d in enumerate(ids):
        after = text[ids[(i + 1) % len(ids)]]
        n = len(text[d]) // 3
        new = text[d][:len(text[d]) - n] + after[:n]
        sig = [O.signature(O.code_points(t)) for t in (text[d], new, after)]
        assert (out[d].n_chars, out[d].edited_sha256) == (len(text[d]), hashlib.sha256(new.encode()).hexdigest())
        assert out[d].fingerprint == O.as_text(sig[0]) and out[d].near_edited == O.likeness(sig[0], sig[1]) and out[d].near_next == O.likeness(sig[0], sig[2])
    assert O.against_next(empty(spark)).count() == 0
    one = O.against_next(frame(spark, [(None, "alone", "en", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_order_minhash_tells_order_and_edits():
    rng = random.Random(2)
    a = words(rng, 300)
    like = lambda x, y: O.likeness(O.signature(O.code_points(x)), O.signature(O.code_points(y)))
    half = len(a) // 2
    assert like(a, a) == 1 and like(a, a[:half] + "Q" + a[half + 1:]) > 0.9 > like(a, a[half:] + a[:half]) and like(a, words(rng, 300)) < 0.1
    block, O.BLOCK = O.BLOCK, 64
    try:
        small = O.signature(O.code_points(a))
    finally:
        O.BLOCK = block
    assert (small == O.signature(O.code_points(a))).all()


# 8


def test_mixing_hits_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(1, 80)), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b"])) for i in range(600)] + [(900, None, None, None), (901, "", "en", "a")]
    docs = frame(spark, rows)
    cells = docs.select("source", "lang", M.topic_of(F.col("text")).alias("topic"), M.tokens_of(F.col("text")).alias("tokens")).fillna("-").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    goal = M.targets(cells)
    table, miss = M.rake(cells, dict(goal))
    assert miss < 1e-5
    pdf = table.toPandas()
    for name in M.MARGINALS:
        want = {r[name]: r["__t"] for r in goal[name].collect()}
        got = pdf.groupby(name).weight.sum()
        assert all(abs(got[k] - v) < 1e-4 for k, v in want.items())
    # the same by arrays
    w = pdf.tokens.to_numpy(float) / pdf.tokens.sum()
    for _ in range(200):
        for name in M.MARGINALS:
            want = {r[name]: r["__t"] for r in goal[name].collect()} if _ == 0 else cache[name]
            cache = (cache if _ or name != M.MARGINALS[0] else {}) | {name: want}
            for v, t in want.items():
                at = (pdf[name] == v).to_numpy()
                w[at] *= t / w[at].sum() if w[at].sum() else 0
    assert np.allclose(w, pdf.weight, atol=1e-5)
    out = M.mix(docs).toPandas()
    assert len(out) == len(rows) and out.probability.between(0, 1).all() and abs((out.n_tokens * out.probability).sum() / out.n_tokens.sum() - M.KEEP) < 0.02
    drawn = M.draw(docs)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == set(out[out.selected].doc_id)
    assert M.mix(empty(spark)).count() == 0


# 9


def test_containment_is_exact(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randint(5, 40))) for i in range(12)] + [(50, "only three words"), (51, None), (52, ""), (53, items_text := words(rng, 30)), (53, items_text)]
    docs = []
    for i in range(60):
        part = (rng.choice(items)[1] or "").split()
        cut = part[:max(1, int(len(part) * rng.choice([0.5, 0.8, 0.9, 1])))]
        docs.append((i, words(rng, rng.randint(0, 400)) + "; " + " ".join(cut).upper() + ". " + words(rng, 20), "en", "s"))
    docs += [(100, None, "en", "s"), (101, "", "en", "s"), (None, items[0][1], "en", "s"), (1, docs[1][1], "en", "s")]
    got = {(r.doc_id, r.item_id, r.n_shared) for r in DC.contained(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sets = lambda t, n: {tuple(w[j:j + n]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for j in range(len(w) - n + 1)}
    want = set()
    for d, t, *_ in docs:
        for i, x in items:
            n = min(5, len(re.findall(r"[^\W_]+", x or "")))
            s = sets(x, n) if n else set()
            if s and 5 * len(s & sets(t, n)) >= 4 * len(s):
                want.add((d, i, len(s & sets(t, n))))
    assert got == want and len(want) > 10
    clean = DC.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - {w[0] for w in want} and clean.columns == frame(spark, docs).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert DC.contained(frame(spark, docs), none).count() == 0 and DC.decontaminate(frame(spark, docs), none).count() == len(docs) and DC.contained(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# 10


def test_automaton_and_context():
    trie = T.Trie(["moron", "idiot", "worthless"])
    for word, term in (("moron", "moron"), ("mroon", None), ("morn", "moron"), ("moroon", "moron"), ("idiat", "idiot"), ("wrthless", "worthless"), ("clean", None), ("", None)):
        assert trie.within_one(word) == term
    m = T.Model({"idiot": 5.0, "worthless": 5.0}, {}, frozenset({"idol"}), 1.0, -2.0)
    assert m.evidence("you are an idiot") == 5.0 and m.evidence('he said "you idiot" to them') < 1 and 0 < m.evidence("what an 1d1ot") < 5 and m.evidence("worthles") == 3.0
    assert m.evidence(None) == m.evidence("") == m.evidence("plain words") == 0.0


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_brute_force():
    rng = random.Random(6)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(30)]
    trie = T.Trie(terms)
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        near = [t for t in terms if brute_distance(w, t) <= 1]
        got = trie.within_one(w)
        assert (got is None) == (not near) and (got is None or got in near)


def test_toxicity_learns_and_keeps_clean(spark):
    rng = random.Random(11)
    bad = ["grobnok", "vexlar", "zumpit"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = words(rng, 60).split()
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, "grobnok vexlar zumpit", "en", "s"), (902, "so zumpitt and vexlar, grobnok!", "en", "s"), (903, "the " * 50000, "en", "s")]
    lab = spark.createDataFrame([*labels, (900, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = T.fit(docs, lab)
    out = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all(out[i].predicted == y for i, y in labels) and out[902].predicted == 1 and out[903].predicted == out[900].predicted == out[901].predicted == 0 and out[None].predicted == 1
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if not r.predicted}
    blank = T.fit(docs, lab.limit(0))
    assert all(r.score < 0.01 for r in T.score(docs, blank).collect()) and T.score(empty(spark), model).count() == 0
    held = docs.select("doc_id", T.held_out(F.col("doc_id")).alias("h")).filter("doc_id is not null").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_models_are_plain_data():
    assert json.dumps(T.Model().terms) == "{}"


def test_a_round_of_raking_joins_its_sums_alone(spark, monkeypatch):
    joins, keep = [], M.Scratch.keep

    def kept(self, df, name, batch=None):
        joins.extend([df._jdf.queryExecution().optimizedPlan().toString().count("Join")] if name.startswith("round") else [])
        return keep(self, df, name, batch)

    monkeypatch.setattr(M.Scratch, "keep", kept)
    cells = spark.createDataFrame([(a, b, c, 10 + i) for i, (a, b, c) in enumerate((a, b, c) for a in "ab" for b in "xy" for c in "tu")], "source string, lang string, topic string, tokens long")
    table, _ = M.rake(cells, M.targets(cells), rounds=2, tolerance=1.0)
    assert set(table.columns) == {"source", "lang", "topic", "tokens", "weight"} and table.count() == 8
    assert joins and max(joins) <= 7  # 14 with targets joined in each step

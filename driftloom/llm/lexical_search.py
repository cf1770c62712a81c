"""Ranked lexical search over a two-level quantised index.

*Score.*  An item's score of a document sums, over the item's terms, the term's weight
times the document's impact ``x = 10**9 tf div (1000 tf + 12 m)``, all in integers; m grows
with the document's length.  Impacts lie below 10**6 and don't depend on the query.

*Index.*  Documents are cut into segments of bounded size.  Level one holds, for each
segment and term, the documents and one byte of impact each, rounded upwards to
multiples of ``STEP``; level two holds the exact term counts.  It is one table, and
Parquet keeps the two levels apart as columns.  Every term of every document is in it;
building takes no exchange.

*Search.*  Upward-rounded bytes give each document an upper bound and, one step less for
every term, a lower bound.  A segment passes on the documents whose upper bound reaches
its own kth lower bound; those whose upper bound reaches the kth lower bound of all
segments are rescored exactly from level two.  Nothing is capped: ties and copies all
pass.  Items are taken in blocks of ``ITEM_ROWS`` terms at most (a longer item is a block of
its own), so that what is sent to all tasks is bounded; each block reads its terms'
postings only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts_for, pieces, text_bytes, utf8

#: Over UTF-8 bytes: digits, ASCII letters and all other code points.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Impacts of one step of the byte level.
STEP = 3922
#: A segment closes at so many bytes of text or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 2048
#: (item, term) rows of a block of items.
ITEM_ROWS = 200_000
#: Bound values of a task that are held at a time.
CELLS = 1 << 22

INDEX = "segment long, term string, docs binary, impacts binary, counts binary, ids array<long>, lengths array<long>"


class Index(NamedTuple):
    """``table``: a row for each segment and term, and one without term that holds the segment's documents."""

    table: DataFrame
    documents: int
    terms: int


def terms(raw: bytes) -> Counter:
    """Terms of a text in UTF-8 and how often each occurs."""
    found: Counter = Counter()
    for piece in pieces(raw, rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"):
        found.update(TERM.findall(piece.lower()))
    return found


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms; exact for any counts."""
    return np.array([75 + 25 * int(x) * documents // total for x in n], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def count_terms(docs: DataFrame) -> DataFrame:
    """The number of terms, with repeats, of every text: for the lengths alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(len(TERM.findall(p)) for p in pieces(x.as_py(), rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")) for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    return docs.select(utf8(F.col("text")).alias("raw")).mapInArrow(work, "n long")


def _segments(documents: int, total: int):
    """Batches (doc_id, raw) as rows of the index."""

    def rows(segment: int, ids: list, lengths: list, held: dict) -> Iterator[pa.RecordBatch]:
        m = length_norm(np.array(lengths, np.int64), documents, total) if total else np.zeros(len(ids), np.int64)
        names = sorted(held)
        columns = [pa.array([segment] * (len(names) + 1), pa.int64()), pa.array([None, *(t.decode() for t in names)], pa.string())]
        docs, impacts, counts = [None], [None], [None]
        sizes = np.array([len(held[t][0]) for t in names], np.int64)
        if names:
            every = np.concatenate([np.array(held[t][0], np.uint16) for t in names])
            tf = np.concatenate([np.array(held[t][1], np.int64) for t in names])
            level = -(-impact(tf, m[every]) // STEP)
            ends = np.cumsum(sizes)
            for a, b in zip(ends - sizes, ends):
                docs.append(every[a:b].tobytes())
                impacts.append(level[a:b].astype(np.uint8).tobytes())
                counts.append(tf[a:b].astype("<u4").tobytes())
        columns += [pa.array(x, pa.binary()) for x in (docs, impacts, counts)]
        columns += [pa.array([x] + [None] * len(names), pa.list_(pa.int64())) for x in (ids, lengths)]
        table = pa.RecordBatch.from_arrays(columns, ["segment", "term", "docs", "impacts", "counts", "ids", "lengths"])
        for at in range(0, table.num_rows, 10_000):
            yield table.slice(at, 10_000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        ids, lengths, held, size = [], [], {}, 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                found, i = terms(raw), len(ids)
                ids.append(doc_id)
                lengths.append(sum(found.values()))
                for term, n in found.items():
                    postings = held.get(term)
                    if postings is None:
                        held[term] = ([i], [n])
                    else:
                        postings[0].append(i)
                        postings[1].append(n)
                size += len(raw)
                if size >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                    yield from rows(segment, ids, lengths, held)
                    segment += 1
                    ids, lengths, held, size = [], [], {}, 0
        if ids:
            yield from rows(segment, ids, lengths, held)

    return work


def build_index(docs: DataFrame, tables: Scratch | None = None) -> Index:
    """The index of ``docs`` (doc_id, text), every term of every row, as a table below the shared folder.

    One pass counts terms for the mean length, a second writes the segments.  Rows
    that repeat a doc_id, or have none, are documents each; null and empty texts
    have no terms.
    """
    tables = tables or Scratch(docs.sparkSession, "lexical")
    n = count_terms(docs).agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)), F.sum("n")).first()
    documents, total = n[0] or 0, n[1] or 0
    found = docs.select(F.col("doc_id").cast("long"), utf8(F.col("text")).alias("raw")).mapInArrow(_segments(documents, total), INDEX)
    return Index(tables.keep(found, "index", batch=500), documents, total)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, repeats) of ``items`` (item_id, text); ``item`` is a hash of id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, item_id, raw in zip(*(c.to_pylist() for c in batch.columns)):
                found = terms(raw)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array([item_id] * len(found), pa.int64()), pa.array([t.decode() for t in found], pa.string()), pa.array(found.values(), pa.int64())],
                                                 ["item", "item_id", "term", "repeats"])

    keyed = items.select(F.xxhash64("item_id", F.coalesce("text", F.lit(""))).alias("item"), F.col("item_id").cast("long"), utf8(F.col("text")).alias("raw"))
    return keyed.dropDuplicates(["item", "item_id"]).mapInArrow(work, "item long, item_id long, term string, repeats long")


class _Block:
    """The terms of a block of items as arrays: for each term, its items and repeats times weight."""

    def __init__(self, rows: list):
        self.items = sorted({r["item"] for r in rows})
        number = {x: i for i, x in enumerate(self.items)}
        self.of: dict[str, tuple] = {}
        for r in rows:
            self.of.setdefault(r["term"], []).append((number[r["item"]], r["repeats"] * r["w"]))
        self.of = {t: tuple(np.array(x, np.int64) for x in zip(*pairs)) for t, pairs in self.of.items()}

    def bounds(self, postings: list[tuple[str, np.ndarray, np.ndarray]], docs: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, documents, lower, upper) where the upper bound reaches the kth lower bound of these documents."""
        step = max(1, CELLS // max(docs, 1))
        for at in range(0, len(self.items), step):
            upper, matched = (np.zeros((min(step, len(self.items) - at), docs), np.int64) for _ in range(2))
            for term, ords, level in postings:
                who, weight = self.of[term]
                here = (who >= at) & (who < at + step)
                if not here.any():
                    continue
                cells = np.ix_(who[here] - at, ords)
                upper[cells] += weight[here, None] * (level.astype(np.int64) * STEP)[None, :]
                matched[cells] += weight[here, None] * (level > 0)[None, :]
            lower = upper - (STEP - 1) * matched
            for i in range(len(upper)):
                kth = np.partition(lower[i], docs - k)[docs - k] if docs > k else 0
                good = np.flatnonzero(upper[i] >= max(kth, 1))
                if len(good):
                    yield at + i, good, lower[i, good], upper[i, good]


def _candidates(block, k: int):
    """Level-one postings sorted by segment, as (item, segment, doc, lower, upper)."""

    def close(segment: int, postings: list) -> pa.RecordBatch:
        docs = int(max(p[1].max() for p in postings)) + 1
        found = list(block.value.bounds(postings, docs, k))
        item = np.repeat([block.value.items[f[0]] for f in found], [len(f[1]) for f in found]).astype(np.int64)
        doc, lower, upper = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (1, 2, 3))
        return pa.RecordBatch.from_pydict({"item": item, "segment": np.full(len(item), segment), "doc": doc.astype(np.int64), "lower": lower, "upper": upper})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for segment, term, docs, impacts in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != now and held:
                    yield close(now, held)
                    held = []
                now = segment
                held.append((term, np.frombuffer(docs, "<u2"), np.frombuffer(impacts, np.uint8)))
        if held:
            yield close(now, held)

    return work


def _rescore(block, documents: int, total: int):
    """The postings and the candidates of a segment, as (item, doc_id, score) from the exact counts."""

    def work(key: tuple, postings: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(postings):
            return pd.DataFrame({"item": [], "doc_id": [], "score": []})
        home = postings[postings["term"].isna()].iloc[0]
        doc = wanted["doc"].to_numpy(np.int64)
        used, place = np.unique(doc, return_inverse=True)
        ids = [None if home["ids"][d] is None or home["ids"][d] != home["ids"][d] else int(home["ids"][d]) for d in used]
        m = length_norm(np.array(home["lengths"], np.int64)[used], documents, total)
        number = {x: i for i, x in enumerate(block.value.items)}
        item = np.array([number[x] for x in wanted["item"]])
        order = np.argsort(item, kind="stable")
        starts = np.searchsorted(item[order], np.arange(len(number) + 1))
        score = np.zeros(len(wanted), np.int64)
        for row in postings[postings["term"].notna()].itertuples():
            ords, tf = np.frombuffer(row.docs, "<u2"), np.frombuffer(row.counts, "<u4").astype(np.int64)
            at = np.searchsorted(ords, used)  # documents of a posting list ascend
            has = ords[np.minimum(at, len(ords) - 1)] == used
            x = np.where(has, impact(np.where(has, tf[np.minimum(at, len(ords) - 1)], 1), m), 0)
            for who, weight in zip(*block.value.of[row.term]):
                mine = order[starts[who]:starts[who + 1]]
                score[mine] += weight * x[place[mine]]
        return pd.DataFrame({"item": wanted["item"], "doc_id": pd.array([ids[p] for p in place], "Int64"), "score": score})

    return work


def _search_block(tables: Scratch, index: Index, wanted: DataFrame, k: int, parts: int) -> DataFrame:
    """(item, doc_id, score) of the candidates of a block of items; ``wanted``: its (item, term, repeats), bounded."""
    spark = index.table.sparkSession
    named = F.broadcast(wanted.select("term").distinct())
    postings = index.table.filter("term is not null").join(named, "term", "left_semi")
    postings = tables.keep(postings.select("segment", "term", "docs", "impacts", "counts"), "postings")
    frequency = postings.groupBy("term").agg(F.sum(F.octet_length("impacts")).alias("df"))
    weight = F.floor(1000 * F.log((2 * index.documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    rows = wanted.join(frequency.select("term", weight.alias("w")), "term").select("item", "term", "repeats", "w").collect()  # at most ITEM_ROWS
    block = spark.sparkContext.broadcast(_Block(rows))
    level_one = postings.select("segment", "term", "docs", "impacts").repartition(parts, "segment").sortWithinPartitions("segment")
    bounds = tables.keep(level_one.mapInArrow(_candidates(block, k), "item long, segment long, doc long, lower long, upper long"), "bounds")
    ranked = bounds.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))).filter(F.col("r") <= k)
    reached = ranked.groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(F.lit(0)).alias("kth"))  # a row for each item of the block
    left = tables.keep(bounds.join(F.broadcast(reached), "item").filter("upper >= kth").select("item", "segment", "doc"), "left")
    homes = index.table.filter("term is null").select("segment", "term", "docs", "counts", "ids", "lengths")
    exact = postings.select("segment", "term", "docs", "counts", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("lengths")).unionByName(homes)
    exact = exact.join(left.select("segment").distinct(), "segment", "left_semi")
    return exact.groupBy("segment").cogroup(left.groupBy("segment")).applyInPandas(_rescore(block, index.documents, index.terms), "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, *, k: int = 20, tables: Scratch | None = None, parts: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each of ``items`` (item_id, text).

    Only scores above 0 count; equal scores go by ascending doc_id, null ids last.
    Items that share id and text are one item, items that share an id alone are
    ranked each; items without terms find nothing, nor does an empty table.  Long
    items and documents count whole.
    """
    tables = tables or Scratch(index.table.sparkSession, "lexical")
    parts = parts or parts_for(index.table.sparkSession, 0)
    asked = tables.keep(item_terms(items), "items")
    rows = asked.count()
    blocks = max(1, -(-rows // ITEM_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        part = _search_block(tables, index, asked.filter(F.col("block") == b), k, parts)
        part = tables.keep(part.filter("score > 0"), "scores")
        found = part if found is None else found.unionByName(part)
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 20) -> DataFrame:
    """``search`` over an index of ``docs`` that is made for it and dropped after."""
    tables = Scratch(docs.sparkSession, "lexical")
    index = build_index(docs, tables)
    out = tables.keep(search(index, items, k=k, tables=tables, parts=parts_for(docs.sparkSession, text_bytes(docs))), "out")
    tables.clear(keep=("out",))
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS MATERIALIZED (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n),
x AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * n) // l)) AS x FROM p, s),
i AS (SELECT item_id, text, term, count(*) AS repeats FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
f AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(repeats * w * x)::BIGINT AS score FROM i JOIN w USING (term) JOIN x USING (term) GROUP BY item_id, text, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

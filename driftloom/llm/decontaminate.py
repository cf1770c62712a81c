"""Benchmark decontamination by size-partitioned MinHash containment (DataFrame only).

An item counts as contained in a document if 4/5 of its distinct five-word shingles
are (an item of fewer words is one shingle of them all).

*Sizes.*  Items are partitioned by their number of shingles, in powers of two.
*Signatures.*  The MinHash signature of an item of n shingles that may miss m of them
(m = n - ceil(0.8 n)) holds its s = min(n, m + SPARE) shingles of least hash.  A partition
of items that may miss some has a threshold: the greatest hash of its signatures, about
m / n of the range.  The signature of a document for it is all its shingle hashes up to
the threshold, whatever its length.  An item that may miss none has one hash, anywhere
in the range: such partitions have the set of their hashes instead of a threshold (up
to ``SET_ROWS`` hashes; their greatest beyond), so that they don't raise that of others.
*Search.*  A document that contains the item misses at most m of the s, so at least
s - m of them are in the document's signature: pairs with fewer matches are out, and no
contained item is missed.  *Verification* counts the exact shingles, as text, of the
pairs that are left.

Rows are told apart by id and text: repeated rows count as one, rows that share only an
id stay apart, and so do items.  A null id is a value.  Null and empty texts contain
nothing and no item without words is contained.  Very long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHINGLE = 5
#: Least share of an item's shingles, as a fraction.
SHARE = (4, 5)
#: Shingles of a signature beyond those that an item may miss: so many must match.
SPARE = 2
#: Hashes of items that may miss none, up to which they are looked up as a set.
SET_ROWS = 10_000
#: Signature rows up to which they are broadcast (about 40 bytes each); more are joined by exchange.
BROADCAST_ROWS = 500_000
FOUND = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingle_hashes(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    every = F.transform(at, lambda i: F.xxhash64(F.lit(n), *[words[i + j] for j in range(n)]))
    return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, n: int) -> Column:
    """All runs of ``n`` words, each joined by spaces."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", *[words[i + j] for j in range(n)]))).otherwise(F.array().cast("array<string>"))


def item_shingles(items: DataFrame) -> DataFrame:
    """Distinct rows (item, item_id, len, h, gram): the shingles of every item with words; ``item`` is a hash of its id and words."""
    split = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(SHINGLE)))
    by_length = [split.filter(F.col("len") == n).select("item_id", "w", "len", F.explode(F.arrays_zip(shingle_hashes(F.col("w"), n).alias("h"), shingle_texts(F.col("w"), n).alias("gram"))).alias("s")) for n in range(1, SHINGLE + 1)]
    rows = by_length[0]
    for more in by_length[1:]:
        rows = rows.unionByName(more)
    return rows.select(F.xxhash64("item_id", "w").alias("item"), "item_id", "len", "s.h", "s.gram").distinct()


def signatures(shingles: DataFrame) -> DataFrame:
    """(size, len, item, item_id, n, need, miss, least, h): the signature of each item, ``least`` of it to be found."""
    whole = Window.partitionBy("item")
    ranked = shingles.withColumns({"n": F.count("*").over(whole), "rank": F.row_number().over(whole.orderBy("h", "gram"))})
    need = F.floor((F.col("n") * SHARE[0] + SHARE[1] - 1) / SHARE[1])
    sized = ranked.withColumns({"need": need, "miss": F.col("n") - need}).withColumn("s", F.when(F.col("miss") > 0, F.least(F.col("n"), F.col("miss") + SPARE)).otherwise(1))
    return sized.filter("rank <= s").select(F.ceil(F.log2("n")).cast("int").alias("size"), "len", "item", "item_id", "n", "need", "miss", (F.col("s") - F.col("miss")).alias("least"), "h")


def _in_signature(top: int | None, named: list[int]) -> Callable[[Column], Column]:
    """Whether a shingle of a document is in its signature for one of the partitions: up to a threshold, or of a set."""
    return lambda h: (F.lit(False) if top is None else h <= F.lit(top)) | (h.isin(named) if named else F.lit(False))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contained`` with ``print``, a hash of the text that tells rows of one id apart."""
    spark = docs.sparkSession
    tables = Scratch(spark, "decontaminate")
    shingles = tables.keep(item_shingles(items), "items")
    sketch = tables.keep(signatures(shingles), "signatures")
    # one row for each size, length of shingles and whether any may be missed: some dozens
    strict = F.col("miss") == 0
    bounds = sketch.groupBy("size", "len", strict.alias("strict")).agg(F.max("h").alias("top"), F.count("*").alias("rows")).collect()
    if not bounds:
        return spark.createDataFrame([], f"print long, {FOUND}")
    few = sum(b["rows"] for b in bounds if b["strict"]) <= SET_ROWS
    named: dict[int, list[int]] = {}
    for r in sketch.filter(strict).select("len", "h").distinct().collect() if few else []:
        named.setdefault(r["len"], []).append(r["h"])
    tops: dict[int, int | None] = {}
    for b in bounds:
        top = tops.setdefault(b["len"], None)
        if not (b["strict"] and few):
            tops[b["len"]] = b["top"] if top is None else max(top, b["top"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    split = keyed.withColumn("w", words_of(F.col("text"))).drop("text")
    low = [F.filter(shingle_hashes(F.col("w"), n), _in_signature(top, named.get(n, []))) for n, top in tops.items()]
    mine = split.select("doc_id", "print", F.explode(F.array_distinct(F.concat(*low))).alias("h"))
    total = sum(b["rows"] for b in bounds)
    pairs = mine.join(_bounded(sketch, total), "h").groupBy("doc_id", "print", "item").agg(F.count("*").alias("hits"), F.first("least").alias("least"))
    found = tables.keep(pairs.filter("hits >= least").select("doc_id", "print", "item"), "found")

    # verification on the text of the shingles: only the documents and items that were found
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["print"] == b["print"])
    marked = found.select("doc_id", "print").distinct().withColumnsRenamed({"doc_id": "f_id", "print": "f_print"})
    suspects = split.join(marked, split["doc_id"].eqNullSafe(marked["f_id"]) & (split["print"] == marked["f_print"]), "left_semi").dropDuplicates(["doc_id", "print"])
    grams = suspects.select("doc_id", "print", F.explode(F.array_distinct(F.concat(*[shingle_texts(F.col("w"), n) for n in tops]))).alias("gram"))
    counted = shingles.groupBy("item").agg(F.count("*").alias("n"))
    wanted = shingles.select("item", "item_id", "gram").join(_bounded(counted, total), "item")
    exact = grams.join(_bounded(wanted, shingles.count()), "gram").groupBy("doc_id", "print", "item", "item_id", "n").agg(F.count("*").alias("n_shared"))
    exact = exact.filter(SHARE[1] * F.col("n_shared") >= SHARE[0] * F.col("n"))
    return (exact.join(found, same(exact, found) & (exact["item"] == found["item"]), "left_semi")
            .select("print", "doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every contained item of ``items`` (item_id, text)."""
    return _contained(docs, items).drop("print")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they were, whatever their names."""
    hit = _contained(docs, items).select(F.col("doc_id").alias("__hit_id"), F.col("print").alias("__hit_print")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__hit_id"]) & (F.xxhash64(docs["text"]) == hit["__hit_print"]), "left_anti")


SQL = """
WITH iw AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
ish AS (SELECT DISTINCT item_id, w, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
n AS (SELECT item_id, w, count(*) AS n FROM ish GROUP BY item_id, w),
lens AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, text, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, text, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lens WHERE len(w) >= k))
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM ds JOIN ish USING (s) JOIN n USING (item_id, w) GROUP BY doc_id, text, item_id, w, n HAVING 5 * count(*) >= 4 * n
"""

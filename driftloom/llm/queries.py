"""The operators of this package bound to the test tables: thin queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .decontaminate import SQL as DECONTAMINATE_SQL
from .fill_in_middle import SQL as FILL_IN_MIDDLE_SQL
from .lexical_search import SQL as LEXICAL_SEARCH_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join_classes

    return join_classes(read(spark, sf_dir, "documents"), words=4, num=85, den=100)


#: For these test tables only; a deployment passes its own secret.
PII_KEY = b"test-tables"


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .licenses import document_path, inherit, scan

    docs = read(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", document_path(F.col("doc_id"), F.col("source")).alias("path"))
    return inherit(files, scan(files))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(read(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    return pseudonymize(read(spark, sf_dir, "documents"), PII_KEY)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import against_next

    return against_next(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained

    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, held_out, score

    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import rank_documents

    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests, fill_in_middle

    return digests(fill_in_middle(read(spark, sf_dir, "documents")))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import link_classes

    return link_classes(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_jaccard": op1_jaccard,
    "op2_licenses": op2_licenses,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op11_lexical_search": op11_lexical_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_simhash": op13_simhash,
}

#: Four base32 signs of each five hex digits of a SHA-1.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {15 - 5 * i}) & 31) + 1, 1)" for g in range(8) for i in range(4))

SQL: dict[str, str] = {
    "op1_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
""",
    # every 100-byte string that starts earlier too, and the maximal runs that these cover
    "op3_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), d AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, length(h) // 2 AS n FROM t),
s AS (SELECT r, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM d, LATERAL (SELECT unnest(range(0, n - 99)) AS i)),
f AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY m ORDER BY r, i) AS k FROM s) WHERE k > 1),
g AS (SELECT r, i, i > 100 + max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apart FROM f),
p AS (SELECT r, i, sum(coalesce(apart, true)::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
spans AS (SELECT r, span, min(i) AS a, max(i) + 100 AS b FROM p GROUP BY r, span),
holes AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM spans),
cut AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM holes JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
""",
    "op4_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM q
""",
    # the checksum goes byte by byte through the table of the reflected polynomial 0xEDB88320
    "op6_sharding": """
WITH bits AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) g(i))),
d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, source, length(h) // 2 + 8 AS size, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, source, size, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, bits),
k AS (SELECT *, coalesce('=' || source, '-') AS src, ('0x' || substr(md5(concat_ws(':', 17, doc_id, text_crc32)), 1, 13))::BIGINT AS k FROM c),
f AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY k, doc_id, text_crc32) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY src) AS frac FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY frac, md5(concat_ws(':', 17, src)), k, doc_id, text_crc32) - 1 AS position, count(*) OVER () AS n FROM f),
s AS (SELECT *, (position * 24 // n)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, position - (shard::BIGINT * n + 23) // 24 AS slot, NULL::INT AS grown_shard, source, position FROM s
""",
    "op9_decontamination": DECONTAMINATE_SQL,
    "op11_lexical_search": LEXICAL_SEARCH_SQL,
    "op12_fill_in_middle": FILL_IN_MIDDLE_SQL,
}

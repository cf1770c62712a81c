"""The registered queries and the pipeline on the small tables."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from driftloom.llm import queries as Q

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    out = Q.QUERIES[name](spark, SMALL)
    rows = out.count()
    table = "pages" if name == "op4_warc" else "documents"
    if name == "op11_lexical_search":
        assert rows == 20 * spark.read.parquet(f"{SMALL}/benchmark.parquet").count()
    elif name != "op9_decontamination":
        assert rows == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{MORE}/{t}.parquet'")
    a, b = Q.QUERIES[name](spark, MORE).toPandas(), con.sql(Q.SQL[name]).df()
    key = sorted(a.columns)
    pd.testing.assert_frame_equal(a[key].sort_values(key).reset_index(drop=True), b[key].sort_values(key).reset_index(drop=True), check_dtype=False)


def test_toxicity_on_the_held_out_fold(spark):
    p = Q.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    m = p[p.held_out].merge(duckdb.connect().sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").df(), on="doc_id")
    assert (m.predicted == m.toxic).mean() > 0.97 and m[m.toxic == 1].predicted.mean() > 0.85


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        now = docs.count()
        assert docs.columns == columns and 0 < now <= last
        last = now
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(out) == last and out.position.is_unique

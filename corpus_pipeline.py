"""Documents through the operators of ``driftloom.llm``, one stage after another.

Toxic documents go, one document of each near-duplicate group stays, documents
that contain a benchmark item go, the rest is sampled to target weights and laid
out in shards.  A stage reads what the stage before it has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom import on_workers
from driftloom.llm import common, decontaminate, jaccard_join, mixing, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on labelled rows of ``docs`` outside the held-out fold."""
    on_workers(spark)
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, Jaccard 0.8; the least doc_id of a group stays."""
    on_workers(spark)
    return jaccard_join.keep_one(docs, words=5, num=8, den=10)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 4/5 of an item's five-word shingles go."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs)


def lay_out_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", draw_mixture),
    ("sharding", lay_out_shards),
]

#: The learned lexicon and the raked weights can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

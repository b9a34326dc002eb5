"""The corpus pipeline: five operators over documents, each on all that the one before it kept.

toxicity      rejects documents that score 0.7 or more
near_dedup    keeps the smallest id of each component of near copies (similarity 0.8 or more)
decontaminate rejects documents that hold a benchmark item
mix           takes each source's documents as often as its target says, in curriculum order
shard         puts every taken row into one of 24 shards of near equal bytes, with a slot

All stages but the last return the columns of documents. Rows with a null id are never rejected as
copies or leaks. Every stage is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm import curriculum, decontaminate, minhash, sharding, toxicity
from heliodor.llm.common import table
from heliodor.llm.queries import read

SHARDS = 24
#: Per cent of similarity of near copies, and bands and rows that miss 2 in a million there.
NEAR, BANDS, ROWS = 80, 56, 7


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, least=NEAR, bands=BANDS, rows=ROWS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mixed_rows(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sharding.assign(docs.select("doc_id", "source", "text"), "doc_id", "text", SHARDS)
    return rows.select("doc_id", "source", "size", "shard", "slot")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]
#: No SQL for a label model or a decomposition; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

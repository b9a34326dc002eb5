"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontaminate, licenses, minhash, oracles, sharding, simhash, substrings, suffixes, toxicity, urls
from .common import ship, table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.dedup(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curriculum.mix(read(spark, sf_dir, "documents"))
    return rows.withColumn("first_position", F.round("first_position", 9))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.with_next(read(spark, sf_dir, "documents"))
    rows = table(spark, rows, "prints")
    c = F.col
    near = simhash.near_counts(rows.select("doc_id", "hi", "lo"), c("doc_id") % 20 == 0, radius=simhash.NEAR).distinct().withColumnRenamed("doc_id", "i")
    return rows.join(near, c("doc_id") == c("i"), "left").select(
        "doc_id", "n_chars", "edited_sha256",
        simhash.text_of(c("hi"), c("lo")).alias("fingerprint"), simhash.text_of(c("edited_hi"), c("edited_lo")).alias("edited_fingerprint"),
        simhash.likeness(c("hi"), c("lo"), c("edited_hi"), c("edited_lo")).alias("near_edited"),
        simhash.likeness(c("hi"), c("lo"), c("next_hi"), c("next_lo")).alias("near_next"), "n_near",
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = sharding.assign(docs.withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8"))), "doc_id", "text", 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_urls": op2_urls, "op7_simhash": op7_simhash, "op8_decontaminate": op8_decontaminate, "op3_toxicity": op3_toxicity, "op1_minhash": op1_minhash, "op4_substrings": op4_substrings, "op6_suffixes": op6_suffixes, "op5_mix": op5_mix, "op9_licenses": op9_licenses, "op10_shards": op10_shards}
ORACLE_SQL = {"op1_minhash": oracles.MINHASH, "op4_substrings": oracles.SUBSTRINGS, "op5_mix": oracles.MIX}

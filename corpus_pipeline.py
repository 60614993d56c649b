"""A corpus pipeline of five operators: each stage works on what the one before kept, written as Parquet and read again.

All stages but the last return the columns of ``documents``; the last one returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_texts
from tessera.llm.common import packed, row_key, sized, written
from tessera.llm.decontam import decontaminate
from tessera.llm.jaccard_forest import keep_one_of_each_group
from tessera.llm.line_rules import apply_quality_rules
from tessera.llm.pii import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their lines over the limit."""
    kept = apply_quality_rules(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    keyed = docs.select(row_key("doc_id", "text").alias("rk"), "text")
    judged = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="rk")
    bad = written(judged.where("contaminated").select("rk").distinct(), "contaminated", True)
    return packed(docs, row_key("doc_id", "text").alias("rk")).join(sized(bad), "rk", "left_anti").select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials are replaced by the names of their kinds."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their hash, and the hash of the text decoded from them."""
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("BPE encoding and decoding", tokens),
]

#: Forests, random fields and byte-pair merges have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

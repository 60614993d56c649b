"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), keep_ids=False)


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_crf import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_forest import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repair_store import store_tokens

    return store_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def token_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids 16 to 48 of each document of the files that op4 writes, by random access."""
    from tessera.llm.common import shared_dir
    from tessera.llm.repair_store import read_slices, write_shards

    path = shared_dir(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return read_slices(spark, path, 16, 48).select("doc_id", F.size("ids").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op6_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op8_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.compaction import TARGET_BYTES, shard_arrivals

    # four arrivals, dealt by the remainder of the id, which SQL can follow; shards' names are of no use in a result
    got = shard_arrivals(table(spark, sf_dir, "documents"), 4, arrival=F.pmod("doc_id", F.lit(4)))
    return got.select("doc_id", "arrival", "text_sha256", "n_chars", (F.col("shard_bytes") <= 2 * TARGET_BYTES).alias("within_target"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.order_minhash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.whitening import whiten

    got = whiten(table(spark, sf_dir, "embeddings"))
    each = got.select("*", F.posexplode("whitened").alias("k", "w"))
    # the contract's type of deviation is long; a sum beyond it is null
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"), F.col("w").alias("whitened"), F.get("explained", F.col("k")).alias("explained"), "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_line_crf": op2_line_crf, "op3_jaccard_forest": op3_jaccard_forest, "op4_repair": op4_repair, "op5_line_rules": op5_line_rules, "op6_rare_tokens": op6_rare_tokens, "op7_skip_chain": op7_skip_chain, "op8_sparse_suffixes": op8_sparse_suffixes, "op9_winnowing": op9_winnowing, "op10_compaction": op10_compaction, "op11_source_divergence": op11_source_divergence, "op12_order_minhash": op12_order_minhash, "op13_whitening": op13_whitening, "token_slices": token_slices}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, random fields, scores and file layouts have no SQL form; those queries are tested in tests/llm."""
    return {"op3_jaccard_forest": sql.JACCARD, "op5_line_rules": sql.LINE_RULES, "op8_sparse_suffixes": sql.PASSAGES, "op9_winnowing": sql.CONTAMINATION, "op10_compaction": sql.STORED, "op11_source_divergence": sql.DIVERGENCE}

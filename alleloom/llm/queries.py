"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontamination, filter_audit, lattice_lm, licenses, metric_join, packing, quality_rules, ranked_search, sharding, simhash, suffix_dedup, token_output
from .common import cut, table
from .oracles import ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.stored(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.fails("base").alias("base_failed"), (~quality_rules.fails("base") & ~quality_rules.fails("v1")).alias("kept"), "failed_bits")


def op1_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted from a ledger of the table as it is now, whatever other queries have stored."""
    return quality_rules.ablations(quality_rules.stored(table(spark, sf_dir, "documents")), "v1")


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(classifier.training_part(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by token ids, which the token files list."""
    return packing.pack_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = cut(ranked_search.index(table(spark, sf_dir, "documents")), "shards")
    return ranked_search.search(shards, table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_rule_ledger, op1_rule_ablations, op2_repair_tokens, op3_simhash_pigeonring, op4_qgram_decontamination, op5_license_minhash, op6_boosted_trees, op7_lattice_likelihood, op8_bounded_ring, op9_length_buckets, op9_token_buckets, op10_bwt_repeats, op11_maxscore_search, op12_filter_audit, op13_jaccard_metric_join, pipeline)
}
ORACLE_SQL = ORACLES

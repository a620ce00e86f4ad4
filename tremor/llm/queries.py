"""One query per operator, each over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import (
    cover_tree,
    html_consensus,
    langid_em,
    lm_backoff,
    mixing,
    oracles,
    packing,
    pii_crf,
    quality_ordinal,
    repetition,
    simhash_trie,
    target_resampling,
    token_counts,
    turn_repair,
)
from tremor.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


@query("op2_repetition_coverage", oracles.repetition_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query("op3_semi_markov_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


@query("op4_best_two_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op5_source_mixing", oracles.mixing_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_simhash_trie")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_classes(table(spark, sf_dir, "documents"))


@query("op6_host_path_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract_pages(table(spark, sf_dir, "pages"))


@query("op7_language_mixture")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_em.identify(table(spark, sf_dir, "documents"))


@query("op1_ordinal_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ordinal.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_cover_tree_top_k", oracles.TOP_K)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"))


@query("op10_stupid_backoff")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_backoff.score(table(spark, sf_dir, "documents"))


@query("op11_byte_resampling", oracles.resampling_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_pretoken_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op13_survivor_repair", oracles.turn_repair_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_conversations(table(spark, sf_dir, "conversations"), damaged=True)

"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe_automaton, byte_bpe, centroids, chat_events, divergence, dual_tree, language_id, lm_scoring, multi_index_hashing, near_duplicates, packing, secrets, sharding
from loomspark.llm.common import read_table


def op6_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_automaton.encode(docs)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sampled_splitters": sharding.op1_sampled_splitters,
        "op2_multi_index_hashing": multi_index_hashing.op2_multi_index_hashing,
        "op3_probminhash_near_duplicates": near_duplicates.op3_probminhash_near_duplicates,
        "op4_dual_tree_top_products": dual_tree.op4_dual_tree_top_products,
        "op5_harmonic_packing": packing.op5_harmonic_packing,
        "op7_event_sourced_chat": chat_events.op7_event_sourced_chat,
        "op8_byte_cnn_language": language_id.op8_byte_cnn_language,
        "op9_cross_entropy_difference": lm_scoring.op9_cross_entropy_difference,
        "op10_entropy_secret_scan": secrets.op10_entropy_secret_scan,
        "op6_tokenization_automaton": op6_tokenization_automaton,
        "op11_kd_tree_filtering": centroids.op11_kd_tree_filtering,
        "op12_distinct_word_shuffle": byte_bpe.op12_distinct_word_shuffle,
        "op13_baseline_divergence": divergence.op13_baseline_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_dual_tree_top_products": dual_tree.OP4_SQL,
        "op7_event_sourced_chat": chat_events.OP7_SQL,
        "op11_kd_tree_filtering": centroids.OP11_SQL,
        "op13_baseline_divergence": divergence.OP13_SQL,
    }

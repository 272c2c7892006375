"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosen_path, decontamination, exact_dedup, hard_negatives, language_id, language_model, line_dedup, mixing, near_duplicates, prefix_trie, secrets, sharding, token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_block_naming_dedup": exact_dedup.op1_block_naming_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_class_bigram_scoring": language_model.op3_class_bigram_scoring,
    "op4_ngram_jaccard_join": near_duplicates.op4_ngram_jaccard_join,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_token_shards": token_shards.op7_token_shards,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_rendezvous_sharding": sharding.op9_rendezvous_sharding,
    "op10_language_id": language_id.op10_language_id,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_minhash_near_dedup": chosen_path.op12_minhash_near_dedup,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_block_naming_dedup": exact_dedup.OP1_SQL,
    "op2_decontamination": decontamination.OP2_SQL,
    "op4_ngram_jaccard_join": near_duplicates.OP4_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_minhash_near_dedup": chosen_path.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}

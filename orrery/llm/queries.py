"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import chat, decontaminate, hard_negatives, html_text, merkle, minhash, packing, sharding, token_store, toxicity, url_filter, vafile, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transactions": warc.op1_transactions,
    "op2_reply_trees": chat.op2_reply_trees,
    "op3_token_store": token_store.op3_token_store,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_near_duplicates": minhash.op5_near_duplicates,
    "op6_url_models": url_filter.op6_url_models,
    "op7_subword_toxicity": toxicity.op7_subword_toxicity,
    "op8_va_file": vafile.op8_va_file,
    "op9_main_text": html_text.op9_main_text,
    "op10_best_two_fit": packing.op10_best_two_fit,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_rendezvous_shards": sharding.op13_rendezvous_shards,
}

ORACLE_SQL: dict[str, str] = {
    "op1_transactions": warc.ORACLE,
    "op2_reply_trees": chat.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op5_near_duplicates": minhash.ORACLE,
    "op8_va_file": vafile.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_rendezvous_shards": sharding.ORACLE,
}

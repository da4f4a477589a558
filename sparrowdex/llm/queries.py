"""Queries of the training-data operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import embeddings, mixing, pieces, quality_model, quality_rules, secrets, simhash, substrings, tokenfile, toxicity

QUERIES = {
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_token_files": tokenfile.op6_token_files,
    "op7_quality_classifier": quality_model.op7_quality_classifier,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": quality_rules.ORACLE,
}

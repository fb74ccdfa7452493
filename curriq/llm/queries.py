"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name: module of its operator.
MODULES = {
    "op1_nb_char_toxicity": "op1_toxicity",
    "op2_branch_and_bound_topk": "op2_topk",
    "op3_byte_cnn_language": "op3_language",
    "op4_elias_fano_tokens": "op4_elias_fano",
    "op5_boosted_pii": "op5_pii",
    "op6_preference_format": "op6_preferences",
    "op7_simhash_decontamination": "op7_decontaminate",
    "op8_bagminhash_dedup": "op8_dedup",
    "op9_bloom_url_filter": "op9_urls",
    "op10_weighted_mix": "op10_mix",
    "op11_line_dedup": "op11_lines",
    "op12_prefix_trie": "op12_trie",
    "op13_token_alignment": "op13_alignment",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"curriq.llm.{module}"), name) for name, module in MODULES.items()}
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"curriq.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    import corpus_pipeline

    return {k: v for k, v in (found | {"pipeline": corpus_pipeline.ORACLE_SQL}).items() if v}

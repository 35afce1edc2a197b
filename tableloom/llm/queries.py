"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, embedding_dedup, exact_dedup, importance, language_model, line_dedup, mixing, packing, sharding, simhash, substring_dedup, token_alignment, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_best_fit_packing": packing.op3_packing,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_language_model": language_model.op10_language_model,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op5_embedding_dedup": embedding_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}

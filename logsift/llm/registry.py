"""The training-data queries and, where SQL can express them, the same as SQL."""

import corpus_pipeline
from logsift.llm import chat_format, decontaminate, embedding_dedup, hard_negatives, importance, language_id, lm_score, oracles, packing, quality, simhash, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_chat_formatting": chat_format.query,
    "op5_best_fit_packing": packing.query,
    "op6_language_id": language_id.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_lm_scoring": lm_score.query,
    "op9_embedding_near_dedup": embedding_dedup.query,
    "pipeline": corpus_pipeline.run,
    "op10_suffix_array_dedup": suffix_dedup.query,
    "op11_importance_resampling": importance.query,
    "op12_hard_negative_mining": hard_negatives.query,
    "op13_toxicity": toxicity.query,
}
ORACLE = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op3_benchmark_decontamination": oracles.DECONTAMINATION,
    "op4_chat_formatting": chat_format.ORACLE_SQL,
    "op9_embedding_near_dedup": oracles.EMBEDDING_DEDUP,
    "op10_suffix_array_dedup": oracles.SUFFIX_DEDUP,
    "op11_importance_resampling": oracles.IMPORTANCE,
    "op12_hard_negative_mining": oracles.HARD_NEGATIVES,
}

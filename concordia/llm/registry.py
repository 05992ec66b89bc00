"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from concordia.llm import (
    decontamination,
    html,
    language,
    licences,
    line_dedup,
    merkle,
    ngram_join,
    packing,
    personal_data,
    quality,
    substring_dedup,
    toxicity,
    whitening,
)

LLM_QUERIES = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_language_id": language.op4_language_id,
    "op5_pii": personal_data.op5_pii,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_license_scans": licences.op8_license_scans,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

LLM_ORACLE = {
    "op7_line_dedup": line_dedup.SQL,
    "op12_substring_dedup": substring_dedup.SQL,
    "op13_merkle_manifest": merkle.SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}

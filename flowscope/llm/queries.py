"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from flowscope.llm import decontaminate, divergence, exact_dedup, filter_audit, hmm, language, license_scan, mixing, ngram_join, pii
from flowscope.llm import token_rollup, toxicity, url_filter


def queries():
    return {
        "op1_pii": pii.op1,
        "op2_token_counts": token_rollup.op2,
        "op3_license_scans": license_scan.op3,
        "op4_benchmark_decontamination": decontaminate.op4,
        "op5_exact_dedup": exact_dedup.op5,
        "op6_ngram_jaccard_join": ngram_join.op6,
        "op7_toxicity": toxicity.op7,
        "op8_language_id": language.op8,
        "op9_mixing": mixing.op9,
        "op10_url_filters": url_filter.op10,
        "op11_hmm_lm": hmm.op11,
        "op12_source_divergence": divergence.op12,
        "op13_filter_audit": filter_audit.op13,
    }


def oracle_sql():
    return {
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op6_ngram_jaccard_join": ngram_join.OP6_SQL,
        "op10_url_filters": url_filter.OP10_SQL,
        "op12_source_divergence": divergence.op12,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }

"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import alignment, exact_dedup, html, language, mixing, ngram_join, privacy, quality, quotations, rules, runs, tokens, winnowing

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_quality": quality.op2_quality,
    "op3_language_id": language.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_privacy": privacy.op5_privacy,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_token_counts": tokens.op7_token_counts,
    "op8_decontamination": winnowing.op8_decontamination,
    "op9_quotation_linking": quotations.op9_quotation_linking,
    "op10_mixing": mixing.op10_mixing,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_quality_rules": rules.op13_quality_rules,
}

ORACLES = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op13_quality_rules": rules.OP13_SQL}

"""Queries and oracle SQL of the operators of this subpackage."""

from __future__ import annotations

from opinia.llm import chosen_path, collocations, decontaminate, html_text, language, licenses, line_dedup, mixing, piecewise, quality, runs, suffix_tree, toxicity

QUERIES = {
    "op3_source_mixing": mixing.query,
    "op10_ngram_jaccard_join": chosen_path.query,
    "op2_line_dedup": line_dedup.query,
    "op6_lm_scoring": suffix_tree.query,
    "op8_html_extraction": html_text.query,
    "op5_language_id": language.query,
    "op7_toxicity": toxicity.query,
    "op4_quality_rules": quality.query,
    "op1_license_scan": licenses.query,
    "op9_benchmark_decontamination": decontaminate.query,
    "op11_document_fingerprints": piecewise.query,
    "op12_phrase_collocations": collocations.query,
    "op13_periodic_runs": runs.query,
}

ORACLES = {
    "op1_license_scan": licenses.SQL,
    "op9_benchmark_decontamination": decontaminate.SQL,
    "op12_phrase_collocations": collocations.SQL,
}

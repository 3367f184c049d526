"""Queries of the training-data operators, one for each."""

from __future__ import annotations

from cairn.llm import ann_search, byte_bpe, decontaminate, license_scan, line_dedup, lm_scoring, simhash_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash_dedup.op2_simhash,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_ann": ann_search.op5_ann,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}

#: Oracle SQL of the queries that SQL can express: none; all are tested against
#: brute force, the libraries they must equal, or held-out rows.
ORACLES: dict[str, str] = {}

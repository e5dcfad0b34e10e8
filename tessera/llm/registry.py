"""Queries and SQL of this subpackage."""

from __future__ import annotations

from tessera.llm import bpe, license_scan, lm, minhash, mixing, quality, rules, topk, toxicity, url_filter

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_bpe": bpe.op7_bpe,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_quality_classifier": quality.op10_quality_classifier,
}
SQL = {"op1_minhash_dedup": minhash.SQL, "op6_exact_topk": topk.SQL, "op8_url_filter": url_filter.SQL, "op9_source_mixing": mixing.SQL}

"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, html_extraction, jaccard_join, packing, quality_crf, quality_rules, secret_scan, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_byte_bpe": byte_bpe.op6_byte_bpe,
        "op7_packing": packing.op7_packing,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_quality_crf": quality_crf.op9_quality_crf,
        "op10_html_extraction": html_extraction.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op4_quality_rules": quality_rules.SQL}

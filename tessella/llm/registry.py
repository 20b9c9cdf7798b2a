"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessella.llm import decontaminate, language_model, license_scan, line_dedup, mixing, simhash, token_files, topk, toxicity, url_filter


def queries() -> dict:
    found = [
        mixing.op1_source_mixing,
        line_dedup.op2_line_dedup,
        url_filter.op3_url_filter,
        simhash.op4_simhash_near_dedup,
        toxicity.op5_toxicity,
        token_files.op6_token_file,
        license_scan.op7_license_scan,
        decontaminate.op8_benchmark_decontamination,
        language_model.op9_lm_scoring,
        topk.op10_exact_top_k,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.OP2_SQL, "op3_url_filter": url_filter.OP3_SQL, "op7_license_scan": license_scan.oracle_sql(), "op10_exact_top_k": topk.OP10_SQL}

"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

from folioscope.llm import decontaminate, langid, licenses, mixing, neardup, suffixdedup, topk, toxicity, urlfilter, warc


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_top_k": topk.op3_top_k,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_suffix_dedup": suffixdedup.op5_suffix_dedup,
        "op6_near_duplicates": neardup.op6_near_duplicates,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_url_filter": urlfilter.op8_url_filter,
        "op9_language_id": langid.op9_language_id,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.sql2(), "op3_top_k": topk.SQL3, "op4_decontaminate": decontaminate.SQL4, "op5_suffix_dedup": suffixdedup.SQL5, "op6_near_duplicates": neardup.SQL6, "op8_url_filter": urlfilter.SQL8, "op10_warc": warc.SQL10}

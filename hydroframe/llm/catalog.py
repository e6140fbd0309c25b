"""Queries of this package by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from hydroframe.llm import bpe, exact_dedup, language_id, line_dedup, near_dedup, packing, quality, substring_dedup, url_filter, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_language_id": language_id.op5_language_id,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_minhash": near_dedup.op7_minhash,
    "op8_warc": warc.op8_warc,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_packing": packing.op10_packing,
}

ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_quality": quality.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_minhash": near_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
}

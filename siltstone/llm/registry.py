"""Queries of this subpackage: name -> callable, and name -> DuckDB SQL where SQL can express it.
The pipeline of the root script is registered by the entry module."""

from __future__ import annotations

from siltstone.llm import (
    chat_format, decontaminate, html_extract, license_scan, line_crf, ngram_join, packing, quality_resample, substring_dedup, toxicity,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_packing": packing.op3_packing,
    "conversation_packing": packing.conversation_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality_resample": quality_resample.op5_quality_resample,
    "op6_line_crf": line_crf.op6_line_crf,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_license_scan": license_scan.op10_license_scan,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op8_chat_format": chat_format.SQL,
    "op10_license_scan": license_scan.SQL,
}

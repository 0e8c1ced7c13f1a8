"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import align, decontam, exact_dedup, html, langid, quality, search, secrets, sentencepiece, simhash, substring, suffix, urls

QUERIES = {
    "op1_sentencepiece": sentencepiece.op1_sentencepiece,
    "op2_html_extract": html.op2_html_extract,
    "op3_quality": quality.op3_quality,
    "op4_language_id": langid.op4_language_id,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_decontaminate": decontam.op9_decontaminate,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_ranked_search": search.op12_ranked_search,
    "op13_url_filter": urls.op13_url_filter,
}

SQL = {
    "op6_substring_dedup": substring.SQL,
    "op8_secret_scan": secrets.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_ranked_search": search.SQL,
    "op13_url_filter": urls.SQL,
}

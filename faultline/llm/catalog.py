"""Registered queries of this subpackage and, where SQL can express them, the checking SQL."""

from __future__ import annotations

from faultline.llm import bpe, decontaminate, html_extract, license_scan, manifest, multi_index, phrases, sanitise, simhash, token_store, toxicity, url_filter, vector_search

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_license_scan": license_scan.query,
    "op3_vector_search": vector_search.query,
    "op4_simhash": simhash.query,
    "op5_token_store": token_store.query,
    "op6_decontaminate": decontaminate.query,
    "op7_sanitise": sanitise.query,
    "op8_toxicity": toxicity.query,
    "op9_bpe": bpe.query,
    "op10_html_extract": html_extract.query,
    "op11_multi_index": multi_index.query,
    "op12_phrases": phrases.query,
    "op13_manifest": manifest.query,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_license_scan": license_scan.ORACLE,
    "op3_vector_search": vector_search.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op11_multi_index": multi_index.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_manifest": manifest.ORACLE,
}

"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from . import byte_bpe, decontaminate, line_dedup, periodic_runs, quality_gam, secret_scan, simhash, spelling, token_store, topk_search, toxicity_gru, url_filter, warc_bundle

_QUERIES = {
    "op1_topk_search": topk_search.query,
    "op2_secret_scan": secret_scan.query,
    "op3_quality_gam": quality_gam.query,
    "op4_line_dedup": line_dedup.query,
    "op5_simhash": simhash.query,
    "op6_token_store": token_store.query,
    "op7_decontaminate": decontaminate.query,
    "op8_toxicity_gru": toxicity_gru.query,
    "op9_warc_bundle": warc_bundle.query,
    "op10_byte_bpe": byte_bpe.query,
    "op11_spelling": spelling.query,
    "op12_url_filter": url_filter.query,
    "op13_periodic_runs": periodic_runs.query,
}

_ORACLES = {
    "op1_topk_search": topk_search.ORACLE,
    "op9_warc_bundle": warc_bundle.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_url_filter": url_filter.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

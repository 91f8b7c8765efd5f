"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from touchline.llm import alignment, decontaminate, divergence, langid, licenses, lm, mixing, neighbours, pii, quality, simhash, tokens, urls

QUERIES = {
    "op1_lm_scoring": lm.query,
    "op2_mixing": mixing.query,
    "op3_simhash": simhash.query,
    "op4_license_scan": licenses.query,
    "op5_decontamination": decontaminate.query,
    "op6_language_id": langid.query,
    "op7_url_filters": urls.query,
    "op8_quality_rules": quality.query,
    "op9_pii": pii.query,
    "op10_token_files": tokens.query,
    "op11_source_divergence": divergence.query,
    "op12_quality_classifier": neighbours.query,
    "op13_tokenizer_alignment": alignment.query,
}

ORACLES = {
    "op4_license_scan": licenses.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_url_filters": urls.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}

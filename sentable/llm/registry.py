"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from sentable.llm import (bpe, decontam, exact_dedup, language_model, licenses, line_dedup, near_dedup, pieces, pq_codes,
                          secrets, spelling, toxicity, warc)

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_decontamination": decontam.query,
    "op4_secret_scan": secrets.query,
    "op5_language_model": language_model.query,
    "op6_near_dedup": near_dedup.query,
    "op7_toxicity": toxicity.query,
    "op8_line_dedup": line_dedup.query,
    "op9_warc": warc.query,
    "op10_sentencepiece": pieces.query,
    "op11_vector_codes": pq_codes.query,
    "op12_spelling_variants": spelling.query,
    "op13_bpe": bpe.query,
}
SQL = {
    "op1_license_scan": licenses.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_secret_scan": secrets.SQL,
    "op9_warc": warc.SQL,
    "op11_vector_codes": pq_codes.SQL,
}

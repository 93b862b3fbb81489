"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import class_lm, conversation_repair, exact_dedup, fingerprints, language, line_dedup, mixing, packing, personal_data, quality, secret_scan, simhash, spelling_variants

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality": quality.query,
    "op3_fingerprints": fingerprints.query,
    "op4_personal_data": personal_data.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_best_fit_packing": packing.query,
    "op7_class_lm": class_lm.query,
    "op8_line_dedup": line_dedup.query,
    "op9_simhash": simhash.query,
    "op10_language_id": language.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_secret_scan": secret_scan.query,
    "pages_language_id": language.query_pages,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
}

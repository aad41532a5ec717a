"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, language, packing, quality_crf, quality_rules, secrets, sharding, token_counts, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_quality_classifier": quality_crf.query,
    "op3_sharding": sharding.query,
    "op4_packing": packing.query,
    "op5_language_id": language.query,
    "op6_token_counts": token_counts.query,
    "op7_ngram_jaccard": jaccard.query,
    "op8_secret_scans": secrets.query,
    "op9_quality_rules": quality_rules.query,
    "op10_warc": warc.query,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}

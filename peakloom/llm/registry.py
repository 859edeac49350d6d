"""The queries of this package, and SQL for those that SQL can express."""

from . import embedding_dedup, line_dedup, media, mixing, packing, pii, quality, secrets, simhash, spelling, toxicity, url_rules, vector_codes

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_url_filters": url_rules.op2_url_filters,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_pii": pii.op5_pii,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_media_columns": media.op7_media_columns,
    "op8_packing": packing.op8_packing,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op2_url_filters": url_rules.ORACLE,
    "op3_secret_scans": secrets.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_embedding_dedup": embedding_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_spelling": spelling.ORACLE,
}

"""The subpackage's queries and their SQL twins."""

from factloom.llm import base_queries, chat, fingerprints, jaccard_join, katz, licenses, line_dedup, packing, pieces, quality, toxicity

QUERIES = {
    "op1_document_fingerprints": fingerprints.query,
    "op2_chat_formatting": chat.query,
    "op3_ngram_jaccard_join": jaccard_join.query,
    "op4_best_fit_packing": packing.query,
    "op5_line_dedup": line_dedup.query,
    "op6_quality_rules": quality.query,
    "op7_toxicity": toxicity.query,
    "op8_license_scans": licenses.query,
    "op9_piece_encoding": pieces.query,
    "op10_katz_backoff": katz.query,
    **base_queries.QUERIES,
}

ORACLE_SQL = {"op2_chat_formatting": chat.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, **base_queries.ORACLE_SQL}

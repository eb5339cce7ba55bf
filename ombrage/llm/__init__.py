"""Operators that prepare training corpora; nothing else in the library imports them."""

from . import chat_format, decontamination, importance_sampling, media_sequence, mixing, piece_coding, quality_rules, secret_scan, sharding, simhash, toxicity, vector_codes, warc_store

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_warc_store": warc_store.query,
    "op3_lpt_sharding": sharding.query,
    "op4_secret_scan": secret_scan.query,
    "op5_simhash": simhash.query,
    "op6_media_sequence": media_sequence.query,
    "op7_mixing": mixing.query,
    "op8_quality_rules": quality_rules.query,
    "op9_toxicity": toxicity.query,
    "op10_piece_coding": piece_coding.query,
    "op11_vector_codes": vector_codes.query,
    "op12_decontamination": decontamination.query,
    "op13_importance_sampling": importance_sampling.query,
}
ORACLES = {
    "op1_chat_format": chat_format.SQL,
    "op2_warc_store": warc_store.SQL,
    "op7_mixing": mixing.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_decontamination": decontamination.SQL,
    "op13_importance_sampling": importance_sampling.SQL,
}

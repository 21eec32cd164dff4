"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from leafmark.llm import (
    embedding_dedup,
    language_model,
    line_dedup,
    merkle,
    minhash,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    url_filters,
    vector_codes,
    warc,
)

QUERIES = {
    "op1_mixing": mixing.op1_query,
    "op2_line_dedup": line_dedup.op2_query,
    "op3_quality_classifier": quality_classifier.op3_query,
    "op4_embedding_dedup": embedding_dedup.op4_query,
    "op5_packing": packing.op5_query,
    "op6_quality_rules": quality_rules.op6_query,
    "op7_sharding": sharding.op7_query,
    "op8_warc": warc.op8_query,
    "op9_minhash": minhash.op9_query,
    "op10_url_filters": url_filters.op10_query,
    "op11_language_model": language_model.op11_query,
    "op12_vector_codes": vector_codes.op12_query,
    "op13_merkle": merkle.op13_query,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_url_filters": url_filters.OP10_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}

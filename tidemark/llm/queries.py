"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import embedding_dedup, fingerprints, maxent, minhash, mixing, packing, pii, quality, sharding, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_lm_scoring": maxent.op4_lm_scoring,
    "op5_minhash": minhash.op5_minhash,
    "op6_sharding": sharding.op6_sharding,
    "op7_pii": pii.op7_pii,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op8_containment": fingerprints.op8_containment,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality": quality.op10_quality,
}

ORACLES = {**fingerprints.ORACLE, **url_filter.ORACLE, **mixing.ORACLE, **embedding_dedup.ORACLE, **sharding.ORACLE}

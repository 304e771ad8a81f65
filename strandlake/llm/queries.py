"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from strandlake.llm import ann, language_id, line_dedup, media, mixing, near_dedup, packing, sharding, toxicity, warc

QUERIES = {
    "op1_media_columns": media.query,
    "op2_consistent_hash_sharding": sharding.query,
    "op3_collision_counting_ann": ann.query,
    "op4_warc_boundary_chain": warc.query,
    "op5_noisy_channel_toxicity": toxicity.query,
    "op6_minhash_near_dedup": near_dedup.query,
    "op7_language_id": language_id.query,
    "op8_hierarchical_mixing": mixing.query,
    "op9_line_dedup": line_dedup.query,
    "op10_best_fit_packing": packing.query,
}

SQL = {
    "op4_warc_boundary_chain": warc.SQL,
    "op6_minhash_near_dedup": near_dedup.SQL,
    "op8_hierarchical_mixing": mixing.SQL,
    "op9_line_dedup": line_dedup.SQL,
}

"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from rangegrid.llm import chat, fingerprints, mixing, near, packing, pipeline, quality, records, repeats, secrets, shards

QUERIES = {
    "op1_suffix_dedup": repeats.query,
    "op2_mix_sources": mixing.query,
    "op3_token_records": records.query,
    "op4_chat_windows": chat.query,
    "op5_near_join": near.query,
    "op6_secret_scan": secrets.query,
    "op7_fingerprints": fingerprints.query,
    "op8_sharding": shards.query,
    "op9_best_fit_packing": packing.query,
    "op10_quality_rules": quality.query,
    "pipeline": pipeline.run,
}
ORACLE_SQL = {"op2_mix_sources": mixing.SQL, "op8_sharding": shards.SQL, "op10_quality_rules": quality.sql()}

"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    attention_lm,
    chat_schema,
    fim_boundaries,
    lexical_lemp,
    license_scan,
    mixing_tree,
    packing_hist,
    piece_prefix_table,
    quality_rank,
    simhash_dedup,
    topk_nra,
    toxicity_pu,
    webp_lossless,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_quality_bradley_terry": quality_rank.op5_quality_bradley_terry,
    "op1_toxicity_pu": toxicity_pu.op1_toxicity_pu,
    "op6_packing_histogram": packing_hist.op6_packing_histogram,
    "op9_mixing_tree": mixing_tree.op9_mixing_tree,
    "op2_media_webp_lossless": webp_lossless.op2_media_webp_lossless,
    "op3_chat_schema_fingerprint": chat_schema.op3_chat_schema_fingerprint,
    "op7_topk_no_random_access": topk_nra.op7_topk_no_random_access,
    "op8_lm_attention": attention_lm.op8_lm_attention,
    "op10_license_scan": license_scan.op10_license_scan,
    "op4_simhash_near_dedup": simhash_dedup.op4_simhash_near_dedup,
    "op11_lexical_lemp": lexical_lemp.op11_lexical_lemp,
    "op12_piece_prefix_table": piece_prefix_table.op12_piece_prefix_table,
    "op13_fim_boundary_select": fim_boundaries.op13_fim_boundary_select,
}
ORACLES: dict[str, str] = {
    "op3_chat_schema_fingerprint": chat_schema.ORACLE,
    "op7_topk_no_random_access": topk_nra.ORACLE,
    "op10_license_scan": license_scan.ORACLE,
    "op11_lexical_lemp": lexical_lemp.ORACLE,
    "op13_fim_boundary_select": fim_boundaries.ORACLE,
}

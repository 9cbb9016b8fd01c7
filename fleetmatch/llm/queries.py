"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetmatch.llm import chat, decontamination, embedding_dedup, exact_dedup, main_text, manifest, mixing, near_dedup, secrets, sharding, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_super_minhash": near_dedup.op1_super_minhash,
    "op2_spherical_cells": embedding_dedup.op2_spherical_cells,
    "op3_flow_resharding": sharding.op3_flow_resharding,
    "op4_trigram_secrets": secrets.op4_trigram_secrets,
    "op5_suffix_dedup": exact_dedup.op5_suffix_dedup,
    "op6_automaton_decontamination": decontamination.op6_automaton_decontamination,
    "op7_segment_toxicity": toxicity.op7_segment_toxicity,
    "op8_snapshot_collapse": chat.op8_snapshot_collapse,
    "op9_anchor_dedup": exact_dedup.op9_anchor_dedup,
    "op10_entropy_mixing": mixing.op10_entropy_mixing,
    "op11_whitening": whitening.op11_whitening,
    "op12_main_text": main_text.op12_main_text,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op2_spherical_cells": embedding_dedup.OP2_SQL,
    "op6_automaton_decontamination": decontamination.OP6_SQL,
    "op8_snapshot_collapse": chat.OP8_SQL,
    "op10_entropy_mixing": mixing.OP10_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}

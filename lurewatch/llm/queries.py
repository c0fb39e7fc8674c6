"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from lurewatch.llm import decontaminate, licences, lm, near, pack, paragraphs, pii, quality, repair, repeats, shards, simhash, trie

QUERIES = {
    "op1_best_fit_packing": pack.op1_best_fit_packing,
    "op2_pii_bootstrap": pii.op2_pii_bootstrap,
    "op3_jaccard_groups": near.op3_jaccard_groups,
    "op4_repeated_bytes": repeats.op4_repeated_bytes,
    "op5_licence_scan": licences.op5_licence_scan,
    "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
    "op7_quality_fertility": quality.op7_quality_fertility,
    "op8_maxent_scores": lm.op8_maxent_scores,
    "op9_stratified_shards": shards.op9_stratified_shards,
    "op10_repeated_paragraphs": paragraphs.op10_repeated_paragraphs,
    "op11_simhash_groups": simhash.op11_simhash_groups,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_structure_repair": repair.op13_structure_repair,
}
ORACLES = {
    "op5_licence_scan": licences.oracle(),
    "op9_stratified_shards": shards.ORACLE,
}

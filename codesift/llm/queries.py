"""Queries of the operators in this folder, and their SQL where there is one."""

from __future__ import annotations

from codesift.llm import (
    bin_slack, collocations, exact_dedup, html_text, licences, mixing, packing, personal_data, run_detection, sharding, simhash,
    sketches, toxicity)

QUERIES = {
    "op1_perfect_hash_dedup": exact_dedup.op1_perfect_hash_dedup,
    "op2_text_to_tag": html_text.op2_text_to_tag,
    "op3_pigeonhole_simhash": simhash.op3_pigeonhole_simhash,
    "op4_licence_index": licences.op4_licence_index,
    "op5_length_buckets": packing.op5_length_buckets,
    "op6_bottom_k": sketches.op6_bottom_k,
    "op7_pivotal_mix": mixing.op7_pivotal_mix,
    "op8_external_shuffle": sharding.op8_external_shuffle,
    "op9_counterfactual_toxicity": toxicity.op9_counterfactual_toxicity,
    "op10_weak_supervision_pii": personal_data.op10_weak_supervision_pii,
    "op11_frequency_split_runs": run_detection.op11_frequency_split_runs,
    "op12_suffix_collocations": collocations.op12_suffix_collocations,
    "op13_minimum_bin_slack": bin_slack.op13_minimum_bin_slack,
}
ORACLE = {
    "op1_perfect_hash_dedup": exact_dedup.OP1_SQL,
    "op11_frequency_split_runs": run_detection.OP11_SQL,
    "op12_suffix_collocations": collocations.OP12_SQL,
}

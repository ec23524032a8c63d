"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from aislerank.llm import (
    bitslice, dac, html_text, language, lexical, merkle, mixing, outliers, packing, quality_fm, secret_scan, simhash, toxicity)

QUERIES = {
    "op1_robust_outliers": outliers.op1_robust_outliers,
    "op2_family_then_pairs": language.op2_family_then_pairs,
    "op3_hypergeometric_tree": mixing.op3_hypergeometric_tree,
    "op4_popcount_grid": simhash.op4_popcount_grid,
    "op5_swap_packing": packing.op5_swap_packing,
    "op6_bit_sliced_top": bitslice.op6_bit_sliced_top,
    "op7_line_blocks": html_text.op7_line_blocks,
    "op8_ftrl_toxicity": toxicity.op8_ftrl_toxicity,
    "op9_direct_codes": dac.op9_direct_codes,
    "op10_trigram_index": secret_scan.op10_trigram_index,
    "op11_term_automaton": lexical.op11_term_automaton,
    "op12_factor_quality": quality_fm.op12_factor_quality,
    "op13_postorder_log": merkle.op13_postorder_log,
}
ORACLES = {
    "op6_bit_sliced_top": bitslice.OP6_SQL,
    "op11_term_automaton": lexical.OP11_SQL,
    "op13_postorder_log": merkle.OP13_SQL,
}

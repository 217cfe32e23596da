"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op01_substring, op02_licenses, op03_packing, op04_simhash, op05_lines, op06_topk, op07_quality, op08_sentencepiece, op09_suffix, op10_lm, op11_trie, op12_negatives, op13_shards

QUERIES = {
    "op1_substring_dedup": op01_substring.op1_substring_dedup,
    "op2_license_scan": op02_licenses.op2_license_scan,
    "op3_packing": op03_packing.op3_packing,
    "op4_simhash": op04_simhash.op4_simhash,
    "op5_line_dedup": op05_lines.op5_line_dedup,
    "op6_exact_topk": op06_topk.op6_exact_topk,
    "op7_quality_rules": op07_quality.op7_quality_rules,
    "op8_sentencepiece": op08_sentencepiece.op8_sentencepiece,
    "op9_suffix_dedup": op09_suffix.op9_suffix_dedup,
    "op10_lm_score": op10_lm.op10_lm_score,
    "op11_prefix_trie": op11_trie.op11_prefix_trie,
    "op12_hard_negatives": op12_negatives.op12_hard_negatives,
    "op13_shards": op13_shards.op13_shards,
}
ORACLES = {
    "op2_license_scan": op02_licenses.ORACLE,
    "op5_line_dedup": op05_lines.ORACLE,
    "op6_exact_topk": op06_topk.ORACLE,
    "op11_prefix_trie": op11_trie.ORACLE,
    "op12_hard_negatives": op12_negatives.ORACLE,
}

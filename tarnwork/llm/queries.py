"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tarnwork.llm import bitpack, bpe, exact, lexical, lines, minhash, packing, runs, secrets, sharding, sketches, toxicity, urls

QUERIES = {
    "op1_bottom_k_sketches": sketches.op1_bottom_k_sketches,
    "op2_link_trust": urls.op2_link_trust,
    "op3_circulant_minhash": minhash.op3_circulant_minhash,
    "op4_minimax_shards": sharding.op4_minimax_shards,
    "op5_polynomial_exact_dedup": exact.op5_polynomial_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_cost_balanced_packing": packing.op10_cost_balanced_packing,
    "op11_wand_search": lexical.op11_wand_search,
    "op12_bit_packed_ids": bitpack.op12_bit_packed_ids,
    "op13_lyndon_runs": runs.op13_lyndon_runs,
}

SQL = {
    "op3_circulant_minhash": minhash.OP3_SQL,
    "op5_polynomial_exact_dedup": exact.OP5_SQL,
    "op7_line_dedup": lines.OP7_SQL,
    "op9_secret_scans": secrets.OP9_SQL,
    "op11_wand_search": lexical.OP11_SQL,
}

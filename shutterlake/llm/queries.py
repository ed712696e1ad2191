"""Registered queries of this subpackage and the DuckDB forms of those that SQL can express."""

from shutterlake.llm import bpe, exact_dedup, katz, language_id, lexical, licenses, mixing, packing, quality, simhash, token_counts, topk, whitening

QUERIES = {
    "op1_edit_aware_token_counts": token_counts.op1_edit_aware_token_counts,
    "op2_katz_backoff": katz.op2_katz_backoff,
    "op3_exact_top_k": topk.op3_exact_top_k,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_language_id": language_id.op9_language_id,
    "op10_ordinal_quality": quality.op10_ordinal_quality,
    "op11_multiway_packing": packing.op11_multiway_packing,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES = {
    "op3_exact_top_k": topk.SQL,
    "op6_license_scan": licenses.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_source_mixing": mixing.SQL,
    "op12_lexical_search": lexical.SQL,
}

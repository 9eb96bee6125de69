"""Queries opN_<name> of the subpackage and the SQL that some can be compared with."""

from __future__ import annotations

from . import decontaminate, hilbert_shards, language_kn, lm_interpolated, pack_bfd, pack_bm25, quality_cascade, simhash_dedup, toxicity_zstd, trie_counts

QUERIES = {
    "op1_pack_best_fit": pack_bfd.op1,
    "op2_pack_retrieval": pack_bm25.op2,
    "op3_language_kneser_ney": language_kn.op3,
    "op4_quality_cascade": quality_cascade.op4,
    "op5_lm_deleted_interpolation": lm_interpolated.op5,
    "op6_simhash_bk_tree": simhash_dedup.op6,
    "op7_toxicity_compression": toxicity_zstd.op7,
    "op8_hilbert_shards": hilbert_shards.op8,
    "op9_decontaminate_simhash": decontaminate.op9,
    "op10_trie_token_counts": trie_counts.op10,
}
ORACLE_SQL = {"op4_quality_cascade": quality_cascade.OP4_SQL}

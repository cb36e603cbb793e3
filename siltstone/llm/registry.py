"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import exact_dedup, licenses, media, mixing, near_dup, packing, prefix_trie, quality, ranked_search, secrets, sharding, token_counts, token_files

QUERIES = {
    "op1_ngram_jaccard": near_dup.op1_ngram_jaccard,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_token_files": token_files.op4_token_files,
    "op5_secrets": secrets.op5_secrets,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_packing": packing.op7_packing,
    "op8_media": media.op8_media,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_sharding": sharding.SQL,
    "op9_mixing": mixing.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_ranked_search": ranked_search.SQL,
}

"""The registered queries of this package and their SQL."""

from __future__ import annotations

from lodeframe.llm import decontaminate, embedding_dedup, jaccard_join, lm_scoring, mixing, prefix_trie, quality_rules, secrets, sharding, suffix_dedup, token_alignment, toxicity, url_rules

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_shards": sharding.op5_shards,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_near_vectors": embedding_dedup.op11_near_vectors,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {"op2_decontaminate": decontaminate.OP2_SQL, "op8_jaccard_join": jaccard_join.OP8_SQL, "op11_near_vectors": embedding_dedup.OP11_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}

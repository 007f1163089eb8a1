"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from closetlake.llm import embedding_dedup, fingerprints, jaccard_join, langid, licenses, mixing, prefix_trie, quality, sharding, spelling, tiling, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_language_id": langid.op2_language_id,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_decontamination": tiling.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_sharding": sharding.op9_sharding,
    "pipeline": corpus_pipeline.run,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_source_mixing": mixing.OP3_SQL,
    "op11_embedding_dedup": embedding_dedup.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}

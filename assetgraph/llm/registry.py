"""The queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from assetgraph.llm import alignment, decontamination, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, prefix_trie, quality_rules, sharding, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        line_dedup.op1_line_dedup,
        decontamination.op2_decontamination,
        ngram_join.op3_ngram_join,
        packing.op4_token_packing,
        toxicity.op5_toxicity,
        mixing.op6_mixing,
        sharding.op7_sharding,
        quality_rules.op8_quality_rules,
        warc.op9_warc,
        language_id.op10_language_id,
        alignment.op11_alignment,
        prefix_trie.op12_prefix_trie,
        exact_dedup.op13_exact_dedup,
    )
}

SQL = {"op1_line_dedup": line_dedup.OP1_SQL, "op9_warc": warc.OP9_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_exact_dedup": exact_dedup.OP13_SQL}

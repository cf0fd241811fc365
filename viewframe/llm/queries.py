"""The subpackage's queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viewframe.llm import exact_dedup, html_extract, license_scan, mixing, packing, pii, prefix_trie, quality, simhash, substring_dedup, token_queries, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mixing.op1_mix_sources,
        substring_dedup.op2_suffix_array_dedup,
        html_extract.op3_html_main_text,
        token_queries.op4_token_counts,
        exact_dedup.op5_exact_dedup,
        license_scan.op6_license_scan,
        quality.op7_quality_rules,
        token_queries.op8_bpe_codes,
        simhash.op9_simhash_near_dedup,
        pii.op10_pii,
        packing.op11_best_fit_packing,
        whitening.op12_embedding_whitening,
        prefix_trie.op13_prefix_trie,
    )
}

SQL: dict[str, str] = {"op1_mix_sources": mixing.OP1_SQL, "op2_suffix_array_dedup": substring_dedup.OP2_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL, "op7_quality_rules": quality.OP7_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}

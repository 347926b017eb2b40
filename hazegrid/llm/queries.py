"""Registered queries of this package. Each gives the whole result over its whole table."""

from __future__ import annotations

from hazegrid.llm import (exact_dedup, html_text, jaccard_join, mixing, packing, quality, secret_scan, simhash, token_counts, token_files,
                          toxicity, vector_codes, whitening)
from hazegrid.llm.common import table

QUERIES = {
    "op1_token_counts": lambda spark, d: token_counts.token_counts(table(spark, d, "documents")),
    "op2_curriculum_mix": lambda spark, d: mixing.mixed(table(spark, d, "documents")),
    "op3_quality_rules": lambda spark, d: quality.verdicts(table(spark, d, "documents")),
    "op4_secret_scan": lambda spark, d: secret_scan.digest(table(spark, d, "documents")),
    "op5_html_text": lambda spark, d: html_text.main_text(table(spark, d, "pages")),
    "op6_ngram_jaccard": lambda spark, d: jaccard_join.ngram_jaccard(table(spark, d, "documents")),
    "op7_toxicity": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_best_fit_packing": lambda spark, d: packing.best_fit_packing(table(spark, d, "documents")),
    "op9_token_files": lambda spark, d: token_files.token_files(table(spark, d, "documents")),
    "op10_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents")),
    "op11_vector_codes": lambda spark, d: vector_codes.vector_codes(table(spark, d, "embeddings")),
    "op12_simhash": lambda spark, d: simhash.simhash_classes(table(spark, d, "documents")),
    "op13_whitening": lambda spark, d: whitening.whitened(table(spark, d, "embeddings")),
}

ORACLES: dict[str, str] = {
    "op6_ngram_jaccard": jaccard_join.ORACLE,
    "op3_quality_rules": quality.ORACLE,
    "op2_curriculum_mix": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
}

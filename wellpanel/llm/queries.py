"""The registered queries of the training-data operators and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wellpanel.llm import (
    bpe_tree,
    language_hypervectors,
    minhash_hamming,
    nn_descent,
    pca_filtering,
    pivotal_grams,
    private_spans,
    quality_ftrl,
    source_mixing,
    topk_nra,
    toxic_crf,
    url_templates,
    warc_zstd,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_nra": topk_nra.op1_topk_nra,
    "op2_url_templates": url_templates.op2_url_templates,
    "op3_source_mixing": source_mixing.op3_source_mixing,
    "op4_quality_ftrl": quality_ftrl.op4_quality_ftrl,
    "op5_nn_descent": nn_descent.op5_nn_descent,
    "op6_minhash_near_dedup": minhash_hamming.op6_minhash_near_dedup,
    "op7_byte_bpe": bpe_tree.op7_byte_bpe,
    "op8_toxic_crf": toxic_crf.op8_toxic_crf,
    "op9_language_hypervectors": language_hypervectors.op9_language_hypervectors,
    "op10_warc_zstd": warc_zstd.op10_warc_zstd,
    "op11_pivotal_grams": pivotal_grams.op11_pivotal_grams,
    "op12_private_spans": private_spans.op12_private_spans,
    "op13_pca_filtering": pca_filtering.op13_pca_filtering,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_nra": topk_nra.SQL,
    "op2_url_templates": url_templates.SQL,
    "op3_source_mixing": source_mixing.SQL,
    "op5_nn_descent": nn_descent.SQL,
    "op6_minhash_near_dedup": minhash_hamming.SQL,
    "op10_warc_zstd": warc_zstd.SQL,
    "op11_pivotal_grams": pivotal_grams.SQL,
    "op13_pca_filtering": pca_filtering.SQL,
}

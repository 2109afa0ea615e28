"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import crosstok, decontam, lexical, lm, mixing, neardup, pii, quality, ranking, substring, tokencount, urlfilter, warc
from quillgraph.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": lambda spark, folder: quality.op1_quality_rules(read(spark, folder, "documents")),
        "op2_pii_anchors": lambda spark, folder: pii.op2_pii_anchors(read(spark, folder, "documents")),
        "op3_warc_derivatives": lambda spark, folder: warc.op3_warc_derivatives(read(spark, folder, "pages")),
        "op4_log_bilinear": lambda spark, folder: lm.op4_log_bilinear(read(spark, folder, "documents")),
        "op5_token_counts": lambda spark, folder: tokencount.op5_token_counts(read(spark, folder, "documents")),
        "op6_benchmark_decontamination": lambda spark, folder: decontam.op6_benchmark_decontamination(read(spark, folder, "documents"), read(spark, folder, "benchmark")),
        "op7_ipf_mixing": lambda spark, folder: mixing.op7_ipf_mixing(read(spark, folder, "documents")),
        "op8_url_ratio": lambda spark, folder: urlfilter.op8_url_ratio(read(spark, folder, "pages")),
        "op9_order_minhash": lambda spark, folder: neardup.op9_order_minhash(read(spark, folder, "documents")),
        "op10_paragraph_minhash": lambda spark, folder: substring.op10_paragraph_minhash(read(spark, folder, "documents")),
        "op11_pairwise_ranking": lambda spark, folder: ranking.op11_pairwise_ranking(read(spark, folder, "documents"), read(spark, folder, "labels")),
        "op12_byte_owners": lambda spark, folder: crosstok.op12_byte_owners(read(spark, folder, "documents")),
        "op13_threshold_search": lambda spark, folder: lexical.op13_threshold_search(read(spark, folder, "documents"), read(spark, folder, "benchmark")),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_benchmark_decontamination": decontam.ORACLE,
        "op7_ipf_mixing": mixing.ORACLE,
        "op13_threshold_search": lexical.ORACLE,
    }

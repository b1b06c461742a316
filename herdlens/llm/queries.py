"""Registered queries of the llm operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from herdlens.llm import ann, chat, filter_audit, html_extract, line_dedup, mixing, ngram_join, packing, quality, resampling, sharding, simhash, topk
from herdlens.llm.common import ship
from herdlens.sources.tables import read_table

Builder = Callable[[SparkSession, str], DataFrame]


def _over(table: str, build: Callable[[DataFrame], DataFrame]) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(read_table(spark, sf_dir, table))

    return run


def _with(table: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> Builder:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return build(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, table))

    return run


QUERIES: dict[str, Builder] = {
    "op1_packing": _over("documents", packing.op1_query),
    "op2_top_k": _over("embeddings", topk.op2_query),
    "op5_collision_ann": _over("embeddings", ann.op5_query),
    "op3_html_main_text": _over("pages", html_extract.op3_query),
    "op7_quotation_linking": _over("conversations", chat.op7_query),
    "op4_quality_classifier": _with("labels", quality.op4_query),
    "op6_mix_sources": _over("documents", mixing.op6_query),
    "op8_line_dedup": _over("documents", line_dedup.op8_query),
    "op9_hilbert_sharding": _over("documents", sharding.op9_query),
    "op10_simhash": _over("documents", simhash.op10_query),
    "op11_ngram_jaccard": _over("documents", ngram_join.op11_query),
    "op12_filter_audit": _with("labels", filter_audit.op12_query),
    "op13_resampling": _with("benchmark", resampling.op13_query),
}

SQL: dict[str, str] = {
    "op2_top_k": topk.OP2_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op7_quotation_linking": chat.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op11_ngram_jaccard": ngram_join.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}

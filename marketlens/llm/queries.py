"""Registered queries of the corpus operators, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import bpe, chat, html_text, jaccard, lm, mixing, pii, quality, ranking, token_blocks, topk, url_filter, whitening
from marketlens.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_vocabulary": url_filter.query,
    "op2_source_mix": mixing.query,
    "op3_line_block_text": html_text.query,
    "op4_token_blocks": token_blocks.query,
    "op5_bpe_round_trip": lambda spark, folder: bpe.digest(Tables(spark, folder).documents),
    "op6_log_bilinear_scores": lm.query,
    "op7_importance_quality": quality.query,
    "op8_personal_data": pii.query,
    "op9_uniform_threshold_topk": topk.query,
    "op10_shingle_groups": jaccard.query,
    "op11_polynomial_whitening": whitening.query,
    "op12_treap_ranking": ranking.query,
    "op13_chat_columns": chat.query,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_vocabulary": url_filter.SQL,
    "op2_source_mix": mixing.SQL,
    "op12_treap_ranking": ranking.SQL,
    "op13_chat_columns": chat.SQL,
}

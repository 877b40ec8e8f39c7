"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import (
    chat_template,
    cotraining,
    crf_langid,
    divergence,
    jaccard_join,
    packing,
    quality_rules,
    sentencepiece_codec,
    sharding,
    substring_dedup,
    topk,
    url_filter,
    variants,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_topk": topk.op1_topk,
        "op2_packing": packing.op2_packing,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_quality_classifier": cotraining.op4_quality_classifier,
        "op5_chat_format": chat_template.op5_chat_format,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_language": crf_langid.op7_language,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
        "op11_variants": variants.op11_variants,
        "op12_divergence": divergence.op12_divergence,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.OP1_SQL,
        "op5_chat_format": chat_template.OP5_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op11_variants": variants.OP11_SQL,
        "op12_divergence": divergence.OP12_SQL,
    }

"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import chat, divergence, fingerprints, line_dedup, mixing, neighbours, ngram_join, packing, phrases, quality, sequences, toxicity, warc
from stockloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": lambda spark, sf: ngram_join.op1_ngram_join(table(spark, sf, "documents")),
        "op2_packing": lambda spark, sf: packing.op2_packing(table(spark, sf, "documents")),
        "op3_token_files": lambda spark, sf: sequences.op3_token_files(spark, table(spark, sf, "documents")),
        "op4_line_dedup": lambda spark, sf: line_dedup.op4_line_dedup(table(spark, sf, "documents")),
        "op5_toxicity": lambda spark, sf: toxicity.op5_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op6_mixing": lambda spark, sf: mixing.op6_mixing(table(spark, sf, "documents")),
        "op7_chat": lambda spark, sf: chat.op7_chat(table(spark, sf, "conversations")),
        "op8_fingerprints": lambda spark, sf: fingerprints.op8_fingerprints(table(spark, sf, "documents")),
        "op9_warc": lambda spark, sf: warc.op9_warc(spark, table(spark, sf, "pages")),
        "op10_neighbours": lambda spark, sf: neighbours.op10_neighbours(table(spark, sf, "embeddings")),
        "op11_quality": lambda spark, sf: quality.op11_quality(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op12_phrases": lambda spark, sf: phrases.op12_phrases(table(spark, sf, "documents")),
        "op13_divergence": lambda spark, sf: divergence.op13_divergence(table(spark, sf, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE_SQL,
        "op4_line_dedup": line_dedup.ORACLE_SQL,
        "op6_mixing": mixing.oracle(),
        "op7_chat": chat.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op12_phrases": phrases.ORACLE_SQL,
        "op13_divergence": divergence.ORACLE_SQL,
    }

"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, chat, exact_dedup, langid, licenses, mixing, negatives, quality, sharding, simhash, spelling, token_counts, warc


OPERATORS = (
    sharding.op1_ring_sharding,
    langid.op2_language_id,
    simhash.op3_simhash_near_dedup,
    chat.op4_chat_format,
    warc.op5_warc_transactions,
    licenses.op6_license_scan,
    quality.op7_quality_rules,
    mixing.op8_mix_to_weights,
    bpe.op9_bpe,
    exact_dedup.op10_exact_dedup,
    token_counts.op11_token_counts,
    spelling.op12_spelling_variants,
    negatives.op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": chat.OP4_SQL,
        "op5_warc_transactions": warc.OP5_SQL,
        "op6_license_scan": licenses.OP6_SQL,
        "op7_quality_rules": quality.OP7_SQL,
        "op8_mix_to_weights": mixing.OP8_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }

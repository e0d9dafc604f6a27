"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann, chat, decontam, hardneg, license, mixing, neardup, quality, simhash, tokens, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": tokens.op1_token_output,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontaminate": decontam.op3_decontaminate,
        "op4_near_duplicates": neardup.op4_near_duplicates,
        "op10_quality": quality.op10_quality,
        "op5_licenses": license.op5_licenses,
        "op6_chat": chat.op6_chat,
        "op7_nearest": ann.op7_nearest,
        "op8_urls": urls.op8_urls,
        "op9_mix": mixing.op9_mix,
        "op11_align": align.op11_align,
        "op12_simhash": simhash.op12_simhash,
        "op13_hard_negatives": hardneg.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": chat.OP6_SQL, "op9_mix": mixing.OP9_SQL, "op13_hard_negatives": hardneg.OP13_SQL}

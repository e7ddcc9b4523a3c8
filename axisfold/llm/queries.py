"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, html, language, lm_score, mixing, negatives, periodic, quality, sharding, simhash, spans, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op10_language_id": language.op10_language_id,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_chat_format": chat.op12_chat_format,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "op2_lm_scoring": lm_score.op2_lm_scoring,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_simhash": simhash.op6_simhash,
    "op7_substring_dedup": spans.op7_substring_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_toxicity": toxicity.op9_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_lm_scoring": lm_score.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
}

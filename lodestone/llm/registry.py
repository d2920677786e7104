"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, decontaminate, licences, lines, packing, quality, sharding, simhash, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": licences.op5_license_scan,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_packing": packing.op7_packing,
    "op8_sharding": sharding.op8_sharding,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.OP1_SQL, "op5_license_scan": licences.op5_sql(), "op6_substring_dedup": substring.OP6_SQL, "op9_chat_formatting": chat.OP9_SQL}

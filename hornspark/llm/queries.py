"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, lm_scoring, near_dedup, packing, quality, sharding, substring_dedup, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_chat_format": chat_format.op3_chat_format,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op4_warc": warc.op4_warc,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality": quality.op9_quality,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op2_decontamination": decontamination.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_near_dedup": near_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}

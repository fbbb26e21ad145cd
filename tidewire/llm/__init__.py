"""Operators for preparing training text; nothing else in tidewire imports them."""

from __future__ import annotations

from . import decontam, lengths, linedup, packing, quality, rules, secrets, simhash, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_simhash": simhash.op2_simhash,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_token_histogram": lengths.op5_token_histogram,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pack": packing.op7_pack,
    "op8_secrets": secrets.op8_secrets,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_line_dedup": linedup.op10_line_dedup,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": decontam.ORACLE,
    "op3_warc": warc.ORACLE,
    "op8_secrets": secrets.ORACLE,
    "op9_quality_rules": rules.ORACLE,
}

"""The corpus queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from molframe.llm import bpe, chat, crf, mix, neardup, ogg, quality, spotsigs, suffix, tokencount


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_langid": crf.op2_langid,
        "op3_suffix_dedup": suffix.op3_suffix_dedup,
        "op4_spotsigs": spotsigs.op4_spotsigs,
        "op5_chat": chat.op5_chat,
        "op6_token_counts": tokencount.op6_token_counts,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_mix": mix.op8_mix,
        "op9_ogg": ogg.op9_ogg,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict:
    return {"op5_chat": chat.OP5_SQL, "op8_mix": mix.OP8_SQL}

"""Registered queries of the training-data operators and their SQL."""
from __future__ import annotations

from leverkit.llm import chat, ctw, decontaminate, jaccard, langid, lines, mixing, negatives, neighbours, privacy, runs, simhash, tokens

QUERIES = {
    "op10_nearest": neighbours.op10_nearest,
    "op11_simhash": simhash.op11_simhash,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_periodic_runs": runs.op13_periodic_runs,
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_chat_format": chat.op4_chat_format,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_language_id": langid.op6_language_id,
    "op7_mixing": mixing.op7_mixing,
    "op8_lm_scoring": ctw.op8_lm_scoring,
    "op9_personal_data": privacy.op9_personal_data,
}
ORACLE = {
    "op12_hard_negatives": negatives.ORACLE,
    "op13_periodic_runs": runs.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op4_chat_format": chat.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op7_mixing": mixing.ORACLE,
}

"""The queries of this package and their SQL."""

from __future__ import annotations

from draper.llm import (
    chat_format,
    conversation_repair,
    decontaminate,
    exact_dedup,
    language_id,
    line_dedup,
    personal_data,
    simhash,
    source_mix,
    substring_dedup,
    suffix_dedup,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_source_mix": source_mix.op5_source_mix,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_personal_data": personal_data.op12_personal_data,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

#: DuckDB SQL; the other operators have none and are tested by brute force in tests/llm.
ORACLE = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_source_mix": source_mix.SQL,
    "op7_chat_format": chat_format.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op13_vector_codes": vector_codes.SQL,
}

"""The training-data queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, convtrie, decontaminate, exact, html_text, language, mixing, neardup, quality, sharding, simhash, spelling, toxicity

QUERIES = {
    "op1_fingerprint": simhash.op1_fingerprint,
    "op2_chat_format": chat.op2_chat_format,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html_text": html_text.op6_html_text,
    "op7_mixing": mixing.op7_mixing,
    "op8_quality": quality.op8_quality,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_language": language.op10_language,
    "op11_conversation_trie": convtrie.op11_conversation_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_exact_dedup": exact.op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": chat.SQL_OP2,
    "op9_decontamination": decontaminate.SQL_OP9,
    "op11_conversation_trie": convtrie.SQL_OP11,
    "op12_spelling_variants": spelling.SQL_OP12,
    "op13_exact_dedup": exact.SQL_OP13,
}

"""Queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, chat_format, collocations, decontaminate, exact_dedup, filter_audit, language_id, line_dedup, near_dedup, pii, quality, substring_dedup, token_counts

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_personal_data": pii.op6_personal_data,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_chat_formatting": chat_format.op9_chat_formatting,
    "op10_language_id": language_id.op10_language_id,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_quality": quality.op13_quality,
    "op4_word_counts": token_counts.op4_word_counts,
    "op10_language_id_pages": language_id.op10_language_id_pages,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_word_counts": token_counts.OP4_WORDS_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_chat_formatting": chat_format.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}

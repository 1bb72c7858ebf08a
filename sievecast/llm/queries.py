"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, forest, infill, language, lines, lm, mixing, periodic, quality, simhash, tokenfiles, topk

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_token_counts": tokenfiles.op8_token_counts,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_embedding_near_dedup": forest.op10_embedding_near_dedup,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_source_mixing": mixing.OP3_SQL,
    "op5_exact_topk": topk.OP5_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op8_token_counts": tokenfiles.OP8_SQL,
    "op10_embedding_near_dedup": forest.OP10_SQL,
    "op11_fill_in_middle": infill.OP11_SQL,
    "op12_decontamination": decontaminate.OP12_SQL,
}

"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, exact, html, language, lm, pii, runs, simhash, spelling

QUERIES = {
    "op1_html_text": html.op1_html_text,
    "op2_simhash": simhash.op2_simhash,
    "op3_bpe_encode": bpe.op3_bpe_encode,
    "op4_lm_score": lm.op4_lm_score,
    "op5_chat_windows": chat.op5_chat_windows,
    "op6_ann": ann.op6_ann,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_token_counts": bpe.op8_token_counts,
    "op9_pii": pii.op9_pii,
    "op10_language": language.op10_language,
    "op11_exact_dedup": exact.op11_exact_dedup,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op5_chat_windows": chat.OP5_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op11_exact_dedup": exact.OP11_SQL,
    "op12_periodic_runs": runs.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}

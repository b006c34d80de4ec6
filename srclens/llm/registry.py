"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from srclens.llm import ann, chat, decontaminate, html_text, mixing, neardup, periodic, quality, secret_scan, spelling, tokens, topk, warc

QUERIES = {
    "op1_html": html_text.op1_html,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op3_chat": chat.op3_chat,
    "op4_tokens": tokens.op4_tokens,
    "op6_nearest": ann.op6_nearest,
    "op7_warc": warc.op7_warc,
    "op8_secrets": secret_scan.op8_secrets,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": quality.op10_quality,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_top_k": topk.op13_top_k,
}

ORACLES = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_secrets": secret_scan.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op13_top_k": topk.OP13_SQL,
}

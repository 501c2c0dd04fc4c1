"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from songframe.llm import bpe, cross_tokens, exact_dedup, host_rules, mixing, pii, quality, simhash, token_counts, token_index, turn_repair, url_filter, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_token_index": token_index.op2_token_index,
    "op3_host_rules": host_rules.op3_host_rules,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality": quality.op5_quality,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_cross_tokens": cross_tokens.op11_cross_tokens,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES = {
    "op3_host_rules": host_rules.OP3_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_turn_repair": turn_repair.OP12_SQL,
}

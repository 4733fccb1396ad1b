"""All queries of this package and their SQL."""

from __future__ import annotations

from . import op1_bpe, op2_jaccard, op3_scoring, op4_langid, op5_topk, op6_chat, op7_substrings, op8_mixing, op9_html, op10_fingerprint

MODULES = (op1_bpe, op2_jaccard, op3_scoring, op4_langid, op5_topk, op6_chat, op7_substrings, op8_mixing, op9_html, op10_fingerprint)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}

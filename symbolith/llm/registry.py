"""Queries of the operators of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import align_tokens, bpe, exact_dedup, filter_audit, html_extract, langid, mixing, passages, pii, quality, simhash, suffix_dedup, topk

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_mixing": mixing.op2_mixing,
    "op3_pii": pii.op3_pii,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_html": html_extract.op7_html,
    "op8_passages": passages.op8_passages,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_topk": topk.op12_topk,
    "op13_align_tokens": align_tokens.op13_align_tokens,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op10_quality": quality.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_topk": topk.ORACLE,
}

"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import alignment, ann, bpe, chat, htmltext, jaccard, licenses, linededup, lm, merkle, packing, quality, sharding

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_chat_format": chat.op3_chat_format,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_lm_score": lm.op5_lm_score,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_html_text": htmltext.op7_html_text,
    "op8_packing": packing.op8_packing,
    "op9_ann_search": ann.op9_ann_search,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_sharding": sharding.op11_sharding,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_alignment": alignment.op13_alignment,
}
ORACLE_SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_ngram_jaccard": jaccard.OP2_SQL,
    "op3_chat_format": chat.OP3_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}

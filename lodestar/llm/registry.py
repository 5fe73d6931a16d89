"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from . import bpe, html, imi, langid, minhash, mixing, mtree, phrases, quality, secrets, sharding, spm, suffixes

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_mtree": mtree.op2_mtree,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_minhash_bayes": minhash.op6_minhash_bayes,
    "op7_sharding": sharding.op7_sharding,
    "op8_sentencepiece": spm.op8_sentencepiece,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_secrets": secrets.op10_secrets,
    "op11_phrases": phrases.op11_phrases,
    "op12_bpe": bpe.op12_bpe,
    "op13_hard_negatives": imi.op13_hard_negatives,
}
ORACLES = {
    "op2_mtree": mtree.SQL,
    "op4_mixing": mixing.SQL,
    "op7_sharding": sharding.SQL,
    "op10_secrets": secrets.SQL,
    "op11_phrases": phrases.SQL,
    "op13_hard_negatives": imi.SQL,
}

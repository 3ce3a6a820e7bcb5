"""Queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from . import chat, lexical, media, minhash, mixing, packing, parsing, phrases, quality, secret_scan, suffixes, topk, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        media.op1_media_tiles, mixing.op2_mix, packing.op3_pack, suffixes.op4_suffix_dedup, toxicity.op5_toxicity,
        minhash.op6_minhash, parsing.op7_parsing, secret_scan.op8_secrets, chat.op9_perspectives, quality.op10_quality,
        topk.op11_topk, lexical.op12_lexical, phrases.op13_phrases,
    )
}

ORACLES = {"op9_perspectives": chat.OP9_SQL, "op11_topk": topk.OP11_SQL, "op12_lexical": lexical.OP12_SQL, "op13_phrases": phrases.OP13_SQL}

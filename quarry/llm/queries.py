"""The registered queries of this package and their SQL."""

from __future__ import annotations

from quarry.llm import ann, bpe, chat, collocations, mixing, near_dedup, packing, pages, quality, search, sharding, tokens, whitening

QUERIES = {f.__name__: f for f in (
    sharding.op1_sharding, tokens.op2_token_files, near_dedup.op3_near_dedup, ann.op4_nearest, quality.op5_quality,
    mixing.op6_mixing, bpe.op7_bpe, search.op8_search, pages.op9_main_text, chat.op10_chat, packing.op11_packing,
    collocations.op12_collocations, whitening.op13_whitening)}
ORACLE = {**sharding.ORACLE, **search.ORACLE, **chat.ORACLE, **collocations.ORACLE}

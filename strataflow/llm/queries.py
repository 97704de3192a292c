"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, classify, decontaminate, html, lm, media, packing, sharding, similarity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_chat": chat.op2_chat,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_warc": warc.op4_warc,
    "op5_jaccard": similarity.op5_jaccard,
    "op6_media": media.op6_media,
    "op7_sharding": sharding.op7_sharding,
    "op8_main_text": html.op8_main_text,
    "op9_packing": packing.op9_packing,
    "op10_quality": classify.op10_quality,
}
SQL = {"op1_decontaminate": decontaminate.OP1_SQL, "op4_warc": warc.OP4_SQL, "op5_jaccard": similarity.OP5_SQL}

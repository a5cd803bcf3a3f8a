"""The queries of this subpackage and, where SQL can express one, the same in SQL."""

from __future__ import annotations

from . import bpe, chat, classify, codes, fingerprints, linededup, packing, pieces, sharding, simhash, topk, whitening

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat, linededup.op2_linededup, fingerprints.op3_fingerprints, classify.op4_quality, topk.op5_topk,
        bpe.op6_bpe, packing.op7_packing, classify.op8_toxicity, simhash.op9_simhash, sharding.op10_sharding, whitening.op11_whitening,
        pieces.op12_pieces, codes.op13_codes,
    )
}
ORACLE_SQL = {"op1_chat": chat.OP1_SQL, "op2_linededup": linededup.OP2_SQL, "op5_topk": topk.OP5_SQL, "op13_codes": codes.OP13_SQL}

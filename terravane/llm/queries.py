"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import anchors, bpe, chat, crf, dac, fingerprint, linedup, media, mixing, warc


def queries() -> dict:
    own = (
        media.op1_media_signatures,
        fingerprint.op2_simhash_fingerprints,
        anchors.op3_simhash_anchor_dedup,
        warc.op4_warc_chunks,
        dac.op5_dac_tokens,
        crf.op6_crf_language_id,
        chat.op7_chat_relational,
        mixing.op8_soft_mixing,
        linedup.op9_line_suffix_dedup,
        bpe.op10_bpe_transducer,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_chunks": warc.OP4_SQL, "op7_chat_relational": chat.OP7_SQL, "op9_line_suffix_dedup": linedup.OP9_SQL}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from gritstone.llm import chat, decontaminate, language, merkle, mixing, negatives, runindex, secrets, simhash, tokens, toxicity, transport, vptree

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_runindex": runindex.op2_runindex,
    "op3_mixing": mixing.op3_mixing,
    "op4_transport": transport.op4_transport,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language": language.op6_language,
    "op7_simhash": simhash.op7_simhash,
    "op8_tokens": tokens.op8_tokens,
    "op9_chat": chat.op9_chat,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_negatives": negatives.op11_negatives,
    "op12_vptree": vptree.op12_vptree,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {
    "op2_runindex": runindex.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op12_vptree": vptree.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}

"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import decontaminate, embeddings, langid, lines, mixing, quality, sharding, simhash, tokens, toxicity


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_mix": mixing.op2_mix,
        "op3_simhash": simhash.op3_simhash,
        "op4_embeddings": embeddings.op4_embeddings,
        "op5_tokens": tokens.op5_tokens,
        "op6_quality": quality.op6_quality,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_lines": lines.op8_lines,
        "op9_shards": sharding.op9_shards,
        "op10_decontaminate": decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": mixing.OP2_SQL, "op3_simhash": simhash.OP3_SQL, "op4_embeddings": embeddings.OP4_SQL, "op10_decontaminate": decontaminate.OP10_SQL}

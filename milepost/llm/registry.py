"""Queries of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from . import (bpe, chatfmt, decontam, langid, licenses, lmscore, maintext, neardup, quality,
               repair, resample, sharding, sql, toxicity)


def queries() -> dict:
    return {"op1_toxicity": toxicity.op1_toxicity,
            "op2_byte_bpe": bpe.op2_byte_bpe,
            "op3_license_scan": licenses.op3_license_scan,
            "op4_positional_index": decontam.op4_positional_index,
            "op5_context_mixing": lmscore.op5_context_mixing,
            "op6_bitmask_langid": langid.op6_bitmask_langid,
            "op7_size_shards": sharding.op7_size_shards,
            "op8_risk_rules": quality.op8_risk_rules,
            "op9_text_density": maintext.op9_text_density,
            "op10_ngram_join": neardup.op10_ngram_join,
            "op11_conversation_repair": repair.op11_conversation_repair,
            "op12_importance_resampling": resample.op12_importance_resampling,
            "op13_chat_format": chatfmt.op13_chat_format}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": sql.OP11,
            "op12_importance_resampling": sql.OP12,
            "op13_chat_format": chatfmt.OP13_SQL}

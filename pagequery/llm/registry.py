"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pagequery.llm import fingerprints, lm, packing, secrets, sentencepieces, sharding, simhash, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_simhash": simhash.op2_simhash,
        "op3_lm_score": lm.op3_lm_score,
        "op4_sharding": sharding.op4_sharding,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_topk": topk.op6_topk,
        "op7_sentencepiece": sentencepieces.op7_sentencepiece,
        "op8_packing": packing.op8_packing,
        "op9_secrets": secrets.op9_secrets,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.op1_sql(), "op6_topk": topk.op6_sql(), "op9_secrets": secrets.op9_sql()}

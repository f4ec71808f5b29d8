"""The thin queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, html, langid, neardup, pii, quality, topk, toxicity, trainorder

QUERIES = {
    "op1_html": html.op1_html,
    "op2_pii": pii.op2_pii,
    "op3_quality": quality.op3_quality,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_language_id": langid.op5_language_id,
    "op6_topk": topk.op6_topk,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_training_order": trainorder.op10_training_order,
}

ORACLES: dict[str, str] = {
    "op4_near_dedup": neardup.OP4_SQL,
    "op6_topk": topk.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
}

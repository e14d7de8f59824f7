"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op1_toxicity, op2_simhash, op3_packing, op4_embeddings, op5_maxent, op6_mixing, op7_secrets, op8_token_files, op9_language, op10_matroska, op11_divergence, op12_topk, op13_variants

QUERIES = {
    "op1_toxicity": op1_toxicity.op1_toxicity,
    "op2_simhash": op2_simhash.op2_simhash,
    "op3_packing": op3_packing.op3_packing,
    "op4_embeddings": op4_embeddings.op4_embeddings,
    "op5_maxent": op5_maxent.op5_maxent,
    "op6_mixing": op6_mixing.op6_mixing,
    "op7_secrets": op7_secrets.op7_secrets,
    "op8_token_files": op8_token_files.op8_token_files,
    "op9_language": op9_language.op9_language,
    "op10_matroska": op10_matroska.op10_matroska,
    "op11_divergence": op11_divergence.op11_divergence,
    "op12_topk": op12_topk.op12_topk,
    "op13_variants": op13_variants.op13_variants,
}

ORACLE_SQL = {
    "op6_mixing": op6_mixing.ORACLE,
    "op11_divergence": op11_divergence.ORACLE,
    "op12_topk": op12_topk.ORACLE,
}

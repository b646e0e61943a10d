"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from chainlake.llm import (decontaminate, divergence, exact_dedup, jaccard_join, line_dedup, lm_score, mixing, quality_rules, tool_calls,
                           toxicity, url_filter, vector_codes, warc)

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_warc": warc.op2_warc,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_tool_calls": tool_calls.op9_tool_calls,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_divergence": divergence.op13_divergence,
}

#: The others have no SQL form: drawn slots, trained models, canonical JSON.
ORACLES = {
    "op1_jaccard_join": jaccard_join.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}

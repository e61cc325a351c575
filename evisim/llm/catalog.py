"""Names of the registered queries and their SQL."""

from __future__ import annotations

from evisim.llm import queries as q, sql


def queries() -> dict:
    return {
        "op1_chat_windows": q.op1_chat_windows,
        "op2_exact_dedup": q.op2_exact_dedup,
        "op3_simhash": q.op3_simhash,
        "op4_quality_rules": q.op4_quality_rules,
        "op5_pii_pseudonyms": q.op5_pii_pseudonyms,
        "op6_fuzzy_lines": q.op6_fuzzy_lines,
        "op7_mixing": q.op7_mixing,
        "op8_packing": q.op8_packing,
        "op9_token_counts": q.op9_token_counts,
        "op10_warc_bundles": q.op10_warc_bundles,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": sql.OP2, "op4_quality_rules": sql.OP4, "op7_mixing": sql.OP7}

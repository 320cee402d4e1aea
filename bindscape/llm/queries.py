"""The queries and their SQL that this subpackage gives to the driver's entry module."""

from __future__ import annotations

from . import bpe_automaton, cgk_decontam, click_windows, conversation_repair, extendible_dedup, jaccard_join, language_id, license_scan, link_trust, quality_fm, token_counts, token_records, toxic_neighbours


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_token_records": token_records.op2_token_records,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_bpe": bpe_automaton.op4_bpe,
        "op5_quality_fm": quality_fm.op5_quality_fm,
        "op6_link_trust": link_trust.op6_link_trust,
        "op7_exact_dedup": extendible_dedup.op7_exact_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_cgk_decontam": cgk_decontam.op10_cgk_decontam,
        "op11_toxic_neighbours": toxic_neighbours.op11_toxic_neighbours,
        "op12_click_windows": click_windows.op12_click_windows,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the operator; the others are tested against libraries, brute force or held-out rows."""
    return {"op3_jaccard_join": jaccard_join.OP3_SQL, "op6_link_trust": link_trust.op6_sql(), "op7_exact_dedup": extendible_dedup.OP7_SQL}

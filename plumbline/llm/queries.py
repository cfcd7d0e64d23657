"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from plumbline.llm import consensus, leakage, overlap, packing, pairs, quota, related, sentences


def queries():
    return {
        "p1_found": pairs.p1_found,
        "p1_defect_counts": pairs.p1_defect_counts,
        "p2_found": consensus.p2_found,
        "p2_consensus": consensus.p2_consensus,
        "p2_reviewers": consensus.p2_reviewers,
        "p3_found": related.p3_found,
        "p3_splits": related.p3_splits,
        "p3_report": related.p3_report,
        "p4_found": quota.p4_found,
        "p4_sample": quota.p4_sample,
        "p4_report": quota.p4_report,
        "p5_found": overlap.p5_found,
        "p5_report": overlap.p5_report,
        "p5_coverage": overlap.p5_coverage,
        "p6_packing": packing.p6_packing,
        "p6_report": packing.p6_report,
        "p7_found": leakage.p7_found,
        "p7_item_report": leakage.p7_item_report,
        "p7_clean": leakage.p7_clean,
        "p8_found": sentences.p8_found,
        "p8_units": sentences.p8_units,
    }


def oracle_sql():
    return {"p3_found": related.P3_FOUND_SQL, "p4_found": quota.P4_FOUND_SQL, "p5_coverage": overlap.P5_COVERAGE_SQL}

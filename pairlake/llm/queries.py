"""The queries of the training-data problems, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import (
    p1_ranking,
    p2_truncation,
    p3_pair_defects,
    p4_split_overlap,
    p5_consensus,
    p6_format_duplicates,
    p7_packing,
    p8_mixing,
    p9_personal_data,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: p1_ranking.p1_places(table(s, d, "winrate")),
        "p1_strengths": lambda s, d: p1_ranking.ranking(table(s, d, "winrate")),
        "p1_win_counts": lambda s, d: p1_ranking.win_counts(table(s, d, "winrate")),
        "p2_found": lambda s, d: p2_truncation.cut_records(table(s, d, "llm_responses"), table(s, d, "verdicts"), table(s, d, "prompts")),
        "p2_cut_shares": lambda s, d: p2_truncation.cut_shares(table(s, d, "llm_responses"), table(s, d, "verdicts"), table(s, d, "prompts")),
        "p3_found": lambda s, d: p3_pair_defects.defects(table(s, d, "pairs"), table(s, d, "prompts"), table(s, d, "llm_responses")),
        "p3_report": lambda s, d: p3_pair_defects.defect_report(
            p3_pair_defects.defects(table(s, d, "pairs"), table(s, d, "prompts"), table(s, d, "llm_responses")), table(s, d, "pairs")
        ),
        "p4_found": lambda s, d: p4_split_overlap.p4_pairs(table(s, d, "prompts")),
        "p4_report": lambda s, d: p4_split_overlap.overlap_report(table(s, d, "prompts")),
        "p4_class_pairs": lambda s, d: p4_split_overlap.class_overlaps(table(s, d, "prompts")),
        "p4_members": lambda s, d: p4_split_overlap.memberships(table(s, d, "prompts")),
        "p5_found": lambda s, d: p5_consensus.consensus(table(s, d, "verdicts"))[0].select("prompt_id", "source", "best"),
        "p5_items": lambda s, d: p5_consensus.consensus(table(s, d, "verdicts"))[0],
        "p5_judges": lambda s, d: p5_consensus.consensus(table(s, d, "verdicts"))[1],
        "p5_agreement": lambda s, d: p5_consensus.agreement_compared(table(s, d, "verdicts"), table(s, d, "pairs")),
        "p6_found": lambda s, d: p6_format_duplicates.format_duplicates(table(s, d, "prompts")),
        "p6_copies": lambda s, d: p6_format_duplicates.copies_report(table(s, d, "prompts")),
        "p7_pack": lambda s, d: p7_packing.pack_documents(table(s, d, "documents"), table(s, d, "pack_limits")),
        "p7_fill": lambda s, d: p7_packing.fill_report(p7_packing.pack_documents(table(s, d, "documents"), table(s, d, "pack_limits"))),
        "p9_found": lambda s, d: p9_personal_data.personal_items(table(s, d, "documents")),
        "p9_redacted": lambda s, d: p9_personal_data.redacted(table(s, d, "documents")),
        "p8_mix": lambda s, d: p8_mixing.mix_documents(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: p8_mixing.share_report(
            p8_mixing.mix_documents(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")
        ),
    }


def oracle_sql() -> dict[str, str]:
    """SQL exists where it can say the whole of a query; the others are tested against brute force in tests/llm."""
    return {
        "p1_win_counts": """
            WITH r AS (SELECT DISTINCT ON (x, y, prompt_id) * FROM winrate WHERE x IS NOT NULL AND y IS NOT NULL ORDER BY x, y, prompt_id, outcome IS NULL, loaded_at DESC),
            c AS (SELECT least(x, y) AS x, greatest(x, y) AS y, CASE WHEN x > y THEN 1 - outcome ELSE outcome END AS o,
                  (CASE WHEN x > y THEN len_y - len_x ELSE len_x - len_y END)::DOUBLE AS d FROM r WHERE outcome IS NOT NULL AND x <> y),
            k AS (SELECT x, y, d, count(*)::DOUBLE AS n, sum(o) AS w FROM c GROUP BY ALL),
            m AS (SELECT x, y, sum(d * n) / sum(n) FILTER (WHERE d IS NOT NULL) AS m FROM k GROUP BY ALL)
            SELECT k.x, k.y, coalesce(d, m, 0) AS d, n, w FROM k JOIN m USING (x, y)
        """,
    }

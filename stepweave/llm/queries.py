"""The queries of this package by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepweave.llm import caps, conversations, languages, mixing, packing, pairs, personal, truncation
from stepweave.llm.sql import ORACLES
from stepweave.runtime import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: conversations.left_out_logs(table(s, d, "messages")),
        "p1_conversations": lambda s, d: conversations.conversations(table(s, d, "messages")),
        "p3_found": lambda s, d: caps.capped_trajectories(table(s, d, "trajectories"), table(s, d, "contributors")).where("NOT kept").select("kind", "content_hash"),
        "p3_capped": lambda s, d: caps.capped_trajectories(table(s, d, "trajectories"), table(s, d, "contributors")),
        "p4_found": lambda s, d: caps.best_of_tasks(table(s, d, "trajectories")).select("task_id", "content_hash"),
        "p5_found": lambda s, d: pairs.defective_pairs(table(s, d, "sft_records")),
        "p6_found": lambda s, d: personal.personal_values(table(s, d, "browser_trajectory"), table(s, d, "given_names")),
        "p6_redacted": lambda s, d: personal.redacted_texts(table(s, d, "browser_trajectory"), table(s, d, "given_names")),
        "p7_found": lambda s, d: truncation.cut_values(table(s, d, "browser_trajectory")),
        "p7_shares": lambda s, d: truncation.cut_shares(table(s, d, "browser_trajectory")),
        "p7_limits": lambda s, d: truncation.field_limits(table(s, d, "browser_trajectory")),
        "p8_packed": lambda s, d: packing.packed_documents(table(s, d, "documents"), table(s, d, "containers")),
        "p8_fill": lambda s, d: packing.fill_report(packing.packed_documents(table(s, d, "documents"), table(s, d, "containers")), table(s, d, "containers")),
        "p9_mixture": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.reached_shares(mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets")), table(s, d, "mix_targets")),
        "p10_found": lambda s, d: languages.mislabelled(table(s, d, "documents")),
        "p10_segments": lambda s, d: languages.document_segments(table(s, d, "documents")).drop("n_segments", "right_label"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

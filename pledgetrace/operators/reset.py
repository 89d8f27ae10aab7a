"""What a run generated and no person has touched: the rows a reset would remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import reviewed_keys
from .trail import artifact_status


def generated(t: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
    """Table -> key rows each step of the cascade touches, in order. Every step looks at
    what the steps before it left; anti-joins, so a null key never hides a row."""
    unread = F.col("review_status") == "unreviewed"
    decided = reviewed_keys(t["links"])
    linked = t["budgets"].filter(F.col("evidence_id").isNotNull())
    budgets_out = linked.join(decided, "evidence_id", "left_anti")
    links_out, links_left = t["links"].filter(unread), t["links"].filter(~unread)
    # after both steps evidence is held by reviewed links and by figures on them
    held = links_left.select("evidence_id").unionByName(
        linked.join(decided, "evidence_id", "left_semi").select("evidence_id")).distinct()
    bridge_out = t["artifact_evidence"].join(held, "evidence_id", "left_anti")
    bridge_left = t["artifact_evidence"].join(held, "evidence_id", "left_semi")
    moved = t["artifacts"].filter(F.col("status_evidence_id").isNotNull()).join(
        held.withColumnRenamed("evidence_id", "status_evidence_id"), "status_evidence_id",
        "left_anti")
    cleared = (t["artifacts"].filter(F.col("status_evidence_id").isNull())
               .select("procurement_id").unionByName(moved.select("procurement_id")))
    again = (artifact_status(bridge_left, t["evidence"])
             .filter(F.col("status_evidence_id").isNotNull())
             .join(cleared, "procurement_id", "left_semi"))
    orphaned = t["artifacts"].join(bridge_left.select("procurement_id").distinct(),
                                   "procurement_id", "left_anti")
    evidence_out = t["evidence"].join(held.withColumnRenamed("evidence_id", "id"), "id",
                                      "left_anti")
    used = t["commitments"].filter(F.col("candidate_id").isNotNull()).select(
        F.col("candidate_id").alias("id"))
    candidates_out = t["candidates"].filter(unread).join(used, "id", "left_anti")
    candidates_left = t["candidates"].join(candidates_out.select("id"), "id", "left_anti")
    notes = t["notes"]
    lost = lambda kind, left: notes.filter(F.col("subject_kind") == kind).join(
        left.select(F.col("id").alias("subject_id")), "subject_id", "left_anti")
    return {"budgets": [budgets_out], "links": [links_out], "artifact_evidence": [bridge_out],
            "implementation_artifacts": [moved, again, orphaned], "evidence": [evidence_out],
            "candidates": [candidates_out],
            "notes": [lost("candidate", candidates_left), lost("link", links_left)]}


def reset_counts(t: dict[str, DataFrame]) -> DataFrame:
    """(table, n): how many rows a reset would touch, nothing written."""
    out = None
    for name, steps in generated(t).items():
        for rows in steps:
            one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("table").agg(F.sum("n").alias("n"))


def without_note(candidates: DataFrame, links: DataFrame, evidence: DataFrame,
                 commitments: DataFrame, notes: DataFrame, redo: bool = False) -> DataFrame:
    """(subject_kind, subject_id) of open items a note is still to be written for; links
    only where both of their sides exist."""
    unread = F.col("review_status") == "unreviewed"
    c = candidates.filter(unread).select(F.lit("candidate").alias("subject_kind"),
                                         F.col("id").alias("subject_id"))
    l = (links.filter(unread)
         .join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
         .join(commitments.select(F.col("id").alias("commitment_id")), "commitment_id",
               "left_semi")
         .select(F.lit("link").alias("subject_kind"), F.col("id").alias("subject_id")))
    items = c.unionByName(l)
    return items if redo else items.join(notes.select("subject_kind", "subject_id"),
                                         ["subject_kind", "subject_id"], "left_anti")

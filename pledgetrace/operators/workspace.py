"""One row per promise across the whole process: its mentions, review state and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_title

# fixed values: section order, kinds evidence is searched for, stages
KIND_ORDER = ("objective", "target", "measure", "indicator", "background", "unclear")
SEARCHABLE = ("objective", "measure", "target")
STAGES = ("confirm", "search", "review", "done", "rejected")


def group_key() -> Column:
    return F.concat(F.lower(display_title("normalized_title")), F.col("suggested_type"))


def mentions(candidates: DataFrame) -> DataFrame:
    """Candidates with the display row they belong to and their place in it."""
    return candidates.withColumn("group_key", group_key()).withColumn(
        "place", F.struct("source_page", "id"))


def stage(n_open: Column, n_commitments: Column, n_pending: Column, n_evidence: Column,
          searchable: Column) -> Column:
    """A14."""
    return (F.when(n_open > 0, F.lit("confirm")).when(n_commitments == 0, F.lit("rejected"))
            .when(n_pending > 0, F.lit("review"))
            .when((n_evidence > 0) | ~searchable, F.lit("done")).otherwise(F.lit("search")))


def workspace_rows(candidates: DataFrame, commitments: DataFrame, links: DataFrame,
                   evidence: DataFrame) -> DataFrame:
    """One row per (display title, kind). Mentions and pending links are counted per
    commitment first; the mentions themselves stay a table (``mentions``)."""
    ev = evidence.select(F.col("id").alias("evidence_id"))
    known = links.join(ev, "evidence_id", "left_semi")
    per_commitment = known.groupBy("commitment_id").agg(
        F.count(F.when(F.col("review_status") == "unreviewed", 1)).alias("pending"),
        F.count(F.when(F.col("review_status") == "accepted", 1)).alias("evidence"))
    per_candidate = (commitments.filter(F.col("candidate_id").isNotNull())
                     .select(F.col("id").alias("commitment_id"), "candidate_id")
                     .join(per_commitment, "commitment_id", "left").groupBy("candidate_id")
                     .agg(F.count("*").alias("commitments"), F.sum("pending").alias("pending"),
                          F.sum("evidence").alias("evidence")))
    m = mentions(candidates).join(per_candidate.withColumnRenamed("candidate_id", "id"), "id",
                                  "left")
    unread = F.col("review_status") == "unreviewed"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"n_{c}")
    rows = m.groupBy("group_key").agg(
        F.min_by(F.struct("id", F.col("normalized_title").alias("title"),
                          F.col("suggested_type").alias("kind"),
                          F.col("source_page").alias("first_page")), "place").alias("first"),
        F.min_by("id", F.struct(~unread, F.col("place"))).alias("shown_id"),
        F.count("*").alias("n_mentions"), F.count(F.when(unread, 1)).alias("n_open"),
        total("commitments"), total("pending"), total("evidence"))
    searchable = F.col("first.kind").isin(*SEARCHABLE)
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("first.kind"))
    return rows.select(
        "group_key", "first.*", "shown_id", "n_mentions", "n_open", "n_commitments", "n_pending",
        "n_evidence", searchable.alias("searchable"), rank.cast("int").alias("kind_rank"),
        stage(F.col("n_open"), F.col("n_commitments"), F.col("n_pending"), F.col("n_evidence"),
              searchable).alias("stage"))


def stage_filter(rows: DataFrame, candidates: DataFrame, stage: str = "all", kind: str = "all",
                 q: str = "") -> DataFrame:
    """P23: "all" hides rejected rows; ``q`` is looked for in the title and in the text and
    code of every mention, whatever its case."""
    rows = rows.filter(F.col("stage") != "rejected" if stage == "all"
                       else F.col("stage") == stage)
    if kind != "all":
        rows = rows.filter(F.col("kind") == kind)
    q = q.strip().lower()
    if not q:
        return rows
    holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    named = (mentions(candidates).filter(holds("text") | holds("code"))
             .select("group_key").distinct().withColumn("_named", F.lit(True)))
    return (rows.join(named, "group_key", "left")
            .filter(holds("title") | F.coalesce("_named", F.lit(False))).drop("_named"))


def stage_counts(rows: DataFrame) -> DataFrame:
    """Every stage, empty ones too, and "all", which leaves rejected rows out. One pass
    over the rows."""
    count = lambda c: F.count(F.when(c, 1))
    named = [F.struct(F.lit(s).alias("stage"), count(F.col("stage") == s).alias("n"))
             for s in STAGES]
    every = F.struct(F.lit("all").alias("stage"), count(F.col("stage") != "rejected").alias("n"))
    return rows.agg(F.array(every, *named).alias("c")).select(F.inline("c"))


def shown_mention(rows: DataFrame, candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Per row the picked mention if it is one of its own, else the first open one, else
    the first. picks(group_key, picked)."""
    own = (mentions(candidates).select("group_key", F.col("id").alias("picked"))
           .join(picks, ["group_key", "picked"], "left_semi"))
    return (rows.join(own, "group_key", "left")
            .select("group_key", F.coalesce("picked", "shown_id").alias("shown_id")))


def candidate_views(candidates: DataFrame, notes: DataFrame, status: str | None = None) -> DataFrame:
    """Every candidate, or those of one review status, with its note where one was written;
    notes(subject_kind, subject_id, note) on other things are left aside."""
    if status is not None:
        candidates = candidates.filter(F.col("review_status") == status)
    own = notes.filter("subject_kind = 'candidate'").select(F.col("subject_id").alias("id"), "note")
    return candidates.join(own, "id", "left")

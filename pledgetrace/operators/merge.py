"""Keyed merges of a new run into stored tables.

Each merge returns the next version of the table; ``write_version`` publishes it. A person's
decision on a row is the one thing a run never overwrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import rules as rl
from ..profile import Profile

ID_BUCKETS = 1024


def with_new_ids(rows: DataFrame, keys: Sequence[str], last_id: int = 0,
                 out: str = "id") -> DataFrame:
    """Consecutive ids after ``last_id`` without sorting everything in one task: rows are
    numbered inside hash buckets of their key, buckets start where the ones before end."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(ID_BUCKETS)).cast("int"))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)  # at most ID_BUCKETS rows
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy("_b").orderBy(*keys)
    return (rows.withColumn("_i", F.row_number().over(inside)).join(F.broadcast(starts), "_b")
            .withColumn(out, (F.lit(last_id) + F.col("_s") + F.col("_i")).cast("bigint"))
            .drop("_b", "_s", "_i"))


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def merge(target: DataFrame, incoming: DataFrame, keys: Sequence[str],
          update: Sequence[str] = (), when: Column | None = None,
          order: str | None = None, id_col: str | None = None,
          values: dict[str, Column] | None = None, last_id: int | None = None) -> DataFrame:
    """``incoming`` into ``target`` on ``keys`` (null equals null).

    Known keys take ``update`` columns from the run where ``when`` holds (columns of the target
    are ``t.``, of the run ``n.``); ``values`` replaces single assignments. New keys are
    inserted, their ids continue the stored ones, or ``last_id`` where ``target`` is a part of
    the stored table. With ``order`` the last of several incoming
    rows counts, without it the run's keys are taken to be distinct."""
    cols = target.columns
    if order:
        rest = [c for c in incoming.columns if c not in keys]
        incoming = (incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
                    .select(*keys, "_r.*"))
    t, n = target.alias("t"), incoming.withColumn("_new", F.lit(True)).alias("n")
    if update:
        take = F.col("n._new").isNotNull() & (F.lit(True) if when is None else when)
        pick = lambda c: (values or {}).get(c, F.col(f"n.{c}"))
        old = t.join(n, _same("t", "n", keys), "left").select(*[
            F.when(take, pick(c)).otherwise(F.col(f"t.{c}")).alias(c) if c in update
            else F.col(f"t.{c}") for c in cols])
    else:
        old = target
    fresh = n.join(t.select(*keys).alias("t"), _same("n", "t", keys), "left_anti")
    if id_col:
        # one number
        last = target.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0] if last_id is None else last_id
        fresh = with_new_ids(fresh.drop(id_col), keys, int(last), id_col)
    have = set(fresh.columns)
    return old.unionByName(fresh.select(*[
        F.col(c) if c in have else F.lit(None).cast(target.schema[c].dataType).alias(c)
        for c in cols]))


def reviewed_keys(links: DataFrame) -> DataFrame:
    """Evidence a reviewer has decided on."""
    return (links.filter(F.col("review_status") != "unreviewed")
            .select("evidence_id").distinct())


def first_of(run: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the first by ``order``, then by all other columns, so that every run of the
    same rows takes the same one."""
    rest = [c for c in run.columns if c not in keys]
    if not rest:
        return run.distinct()
    by = [F.col(c) if not isinstance(run.schema[c].dataType, MapType) else F.to_json(c) for c in rest]
    if order in rest:
        by.insert(0, F.col(order))
    return run.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(by)]))
                                  .alias("_r")).select(*keys, "_r.*").select(*run.columns)


def merge_documents(stored: DataFrame, run: DataFrame, order: str | None = None) -> DataFrame:
    """M1: a new (title, publisher, url) is added, known ones stay. Of several new rows the first
    by ``order`` counts."""
    keys = ["title", "publisher", "url"]
    return merge(stored, first_of(run, keys, order), keys, id_col="id")


def merge_candidates(stored: DataFrame, run: DataFrame, order: str | None = None) -> DataFrame:
    """M2: a new (document, page, text) is added unreviewed; known ones keep their review. Of
    several new rows the first by ``order`` counts."""
    keys = ["document_id", "source_page", "text"]
    run = first_of(run.withColumn("review_status", F.lit("unreviewed")), keys, order)
    return merge(stored, run, keys, id_col="id")


def accept_candidates(candidates: DataFrame, commitments: DataFrame, decisions: DataFrame,
                      profile: Profile, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M3: decisions(candidate_id, kind?, title?) -> (candidates, commitments) after review. Of
    several decisions on a candidate the first by ``order``, then by their own values, that names a
    kind gives it, and likewise the title.

    Every decided candidate must exist and hold a verified receipt, or the whole batch fails
    before anything is written. A candidate makes one commitment however often it is accepted."""
    c = candidates.select(F.col("id").alias("candidate_id"), "suggested_type",
                          "normalized_title", "text", "code", "source_page", "source_excerpt",
                          "excerpt_on_page")
    # min_by skips rows whose order is null, as those without a value are
    named = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*[x for x in (order, c) if x]))).alias(c)
    d = decisions.groupBy("candidate_id").agg(named("kind"), named("title"))
    j = d.join(c, "candidate_id", "left")
    ok = F.coalesce(F.col("excerpt_on_page") & (F.trim("source_excerpt") != ""), F.lit(False))
    # checked over the whole batch first, so that one bad id stops all of it
    bad = j.filter(~ok).select("candidate_id").limit(1).collect()
    if bad:
        raise ValueError(f"candidate {bad[0][0]} has no verified source receipt")
    title = F.coalesce(F.nullif("title", F.lit("")), "normalized_title")
    run = j.select("candidate_id", F.coalesce("kind", "suggested_type").alias("kind"),
                   title.alias("title"), F.col("text").alias("summary"), "code", "source_page",
                   rl.jurisdiction(F.concat_ws(" ", title, F.col("text")), profile)
                   .alias("asset_owner_jurisdiction"))
    after = merge(commitments, run, ["candidate_id"], id_col="id")
    marks = d.select(F.col("candidate_id").alias("id"), F.lit("accepted").alias("review_status"))
    return merge(candidates, marks, ["id"], ["review_status"]), after


PASSAGE_FIELDS = ("snippet", "organisations", "locations", "dates_mentioned", "status_hint",
                  "status_excerpt", "polarity", "flags", "procurement_ids", "parcels")


def merge_evidence(stored: DataFrame, run: DataFrame, links: DataFrame,
                   last_id: int | None = None) -> DataFrame:
    """M4: on (commitment, url) the passage fields are refreshed unless a link on the row was
    reviewed; title, publisher and date stay as first stored."""
    flagged = stored.join(reviewed_keys(links).select(
        F.col("evidence_id").alias("id"), F.lit(True).alias("_reviewed")), "id", "left")
    fields = [c for c in PASSAGE_FIELDS if c in stored.columns and c in run.columns]
    return merge(flagged, run, ["commitment_id", "url"], fields,
                 when=F.col("t._reviewed").isNull(), id_col="id", last_id=last_id).drop("_reviewed")


LINK_FIELDS = ("score", "features", "suggested_relationship", "reasons")


def merge_links(stored: DataFrame, run: DataFrame, last_id: int | None = None) -> DataFrame:
    """M5: on (commitment, evidence) only unreviewed links are rescored."""
    fields = [c for c in LINK_FIELDS if c in stored.columns and c in run.columns]
    run = run.withColumn("review_status", F.lit("unreviewed"))
    return merge(stored, run, ["commitment_id", "evidence_id"], fields,
                 when=F.col("t.review_status") == "unreviewed", id_col="id", last_id=last_id)


BUDGET_KEY = ("evidence_id", "kind", "amount_raw", "fiscal_year", "description", "currency")


def merge_budgets(stored: DataFrame, run: DataFrame, links: DataFrame, order: str | None = None,
                  last_id: int | None = None) -> DataFrame:
    """M6: a figure is added once, and never to evidence a reviewer has decided on. Of several rows
    of a figure the first by ``order`` counts."""
    keys = [k for k in BUDGET_KEY if k in stored.columns]
    run = first_of(run.join(reviewed_keys(links), "evidence_id", "left_anti"), keys, order)
    return merge(stored, run, keys, id_col="id" if "id" in stored.columns else None, last_id=last_id)


def merge_sources(stored: DataFrame, run: DataFrame) -> DataFrame:
    """M7: on url everything is refreshed, but an unknown owner keeps the stored one."""
    return merge(stored, run, ["url"], ["title", "publisher", "sort_order", "jurisdiction"],
                 values={"jurisdiction": F.coalesce("n.jurisdiction", "t.jurisdiction")},
                 id_col="id")


def merge_places(stored: DataFrame, run: DataFrame) -> DataFrame:
    """M8: on (kind, name, district) the geometry is refreshed; parcels are insert-only and
    wait unconfirmed."""
    run = run.withColumn("confirmed", F.col("kind") != "parcel")
    return merge(stored, run, ["kind", "name", "district"], ["osm_id", "geojson"],
                 when=F.col("t.kind") != "parcel", id_col="id")


def merge_pages(stored: DataFrame, run: DataFrame) -> DataFrame:
    """M9: pages on url."""
    return merge(stored, run, ["url"], [c for c in ("title", "text", "published_on")
                                        if c in stored.columns], id_col="id")


def replace_chunks(stored: DataFrame, run: DataFrame) -> DataFrame:
    """M9: all passages of a (page, model key) are replaced together."""
    keys = ["page_id", "embed_model"]
    return stored.join(run.select(*keys).distinct(), keys, "left_anti").unionByName(run)


def replace_rows(stored: DataFrame, run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Notes and profiles are replaced on their key."""
    return merge(stored, run, list(keys), [c for c in stored.columns if c not in keys])


def decide_links(links: DataFrame, decisions: DataFrame, order: str) -> DataFrame:
    """decisions(link_id, decision, relationship?, order): the last one per link counts.
    Accepting keeps the suggestion unless overridden, rejecting clears the relationship."""
    run = decisions.withColumnRenamed("link_id", "id").select(
        "id", "relationship", F.col("decision").alias("review_status"), order)
    accepted = F.col("n.review_status") == "accepted"
    return merge(links, run.join(links.select("id"), "id", "left_semi"), ["id"],
                 ["review_status", "relationship"], order=order,
                 values={"relationship": F.when(accepted, F.coalesce(
                     "n.relationship", "t.suggested_relationship"))})


def reject_pending(candidates: DataFrame) -> DataFrame:
    """Every open candidate is rejected."""
    unread = F.col("review_status") == "unreviewed"
    return candidates.withColumn("review_status", F.when(unread, F.lit("rejected"))
                                 .otherwise(F.col("review_status")))


def set_jurisdictions(commitments: DataFrame, decisions: DataFrame, order: str) -> DataFrame:
    """decisions(id, asset_owner_jurisdiction, order): the last owner set counts."""
    known = decisions.join(commitments.select("id"), "id", "left_semi")
    return merge(commitments, known, ["id"], ["asset_owner_jurisdiction"], order=order)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Publish one version of a table below ``root``. Readers open a version that is complete;
    a half-written one has no ``_SUCCESS`` and is simply written again."""
    path = f"{root.rstrip('/')}/v{version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path

"""From commitments and pages to suggested evidence, for all commitments at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as mn
from ..functions import rules as rl
from ..functions import text as tx
from ..profile import Profile
from ..session import stage
from . import matching as mt
from . import places as pl
from . import retrieval as rt
from . import sourcing as so
from .chunking import chunk
from .index import index_pages
from .merge import with_new_ids
from .trail import artifact_status, regressed_evidence

TOP_DOCUMENTS, CANDIDATES = 5, 20
KEYS = ["page_id", "chunk_index"]
FOUND = "orgs array<string>, places array<string>, dates array<string>"


def entities(text: Column | str, finder: Callable[[], Callable] | None = None) -> Column:
    """struct(orgs, places, dates) of a passage. ``finder()`` gives a function from a text to
    those three lists; without one only bare years are found. Years always count as dates."""
    years = tx.years(text)
    none = F.array().cast("array<string>")
    if finder is None:
        return F.struct(none.alias("orgs"), none.alias("places"), years.alias("dates"))

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = finder()
        for batch in batches:
            rows = [tuple(map(list, find(t))) for t in batch]
            yield pd.DataFrame(rows, columns=["orgs", "places", "dates"], index=batch.index)

    found = run(tx._col(text))
    return F.struct(tx.dedupe_names(found["orgs"]).alias("orgs"),
                    tx.dedupe_names(found["places"]).alias("places"),
                    tx.dedupe_names(F.concat(found["dates"], years)).alias("dates"))


def lemmas(text: Column | str, analyzer: Callable[[], Callable] | None = None) -> Column:
    """the words the lexical index sees. ``analyzer()`` gives a function from a text to its
    lemmas; without one the lowercased words are taken."""
    if analyzer is None:
        return F.array_join(tx.terms(text), " ")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyze = analyzer()
        for batch in batches:
            yield batch.map(lambda t: None if t is None else " ".join(analyze(t)))

    return run(tx._col(text))


def rank_documents(queries: DataFrame, pages: DataFrame, profile: Profile,
                   k: int = CANDIDATES, provider=rt.HashedVectors,
                   scorer: Callable[[], Callable] | None = None,
                   eligible: rt.Eligible | None = None, store: str | None = None) -> DataFrame:
    """Per query the pages in order of their best passage, copies left out.

    queries(query_id, chunk), pages(page_id, url, title, text, …). With ``eligible`` a query sees
    only its own pages. With ``store`` passages and vectors come from there, and only new or changed
    pages are embedded. Matching sees passages as keys and text only; the few passages that win are
    then joined to their pages, which is far less than carrying every page's columns through the
    ranking. Where a reranker fails, its queries keep the retrieval order (``rerank_failed``)."""
    if eligible is not None:
        pages = rt.seen_by_any(pages, eligible)
    text = pages.select("page_id", "text")
    kept = None if store is None else index_pages(
        text, store, model=getattr(provider, "model", provider.__name__), provider=provider)
    hits = stage(rt.match_hybrid(
        queries.select("query_id", "chunk"), chunk(text) if kept is None else kept, KEYS, k, text="chunk",
        vector=None if kept is None else "vector", provider=provider, eligible=eligible), "hits")
    if kept is None:
        won = chunk(pages.join(hits.select("page_id").distinct(), "page_id", "left_semi"))
    else:
        won = kept.drop("vector").join(hits.select(*KEYS).distinct(), KEYS, "left_semi").join(pages.drop("text"), "page_id")
    rows = hits.join(won, KEYS)
    rank = "rank"
    if scorer is not None:
        asked = rows.join(queries.select("query_id", F.col("chunk").alias("_q")), "query_id")
        # read twice below, but scored once
        scored = stage(asked.withColumn("rerank_score", rt.rerank_scores("_q", "chunk", scorer, strict=False)).drop("_q"),
                       "scored")
        rows, rank = rt.rerank(scored, k, ["query_id"]), "reranked"
    words = tx.title_tokens("title", profile.title_stopwords)
    return rt.best_per_document(rows, "query_id", "url", words, rank)


def read_passages(ranked: DataFrame, profile: Profile, baseline_year: int | None,
                  finder=None) -> DataFrame:
    """E16, E11, E14 on each matched passage: what it says, one projection."""
    text = F.col("chunk")
    stale = (F.coalesce(F.col("published_year") < baseline_year, F.lit(False))
             if baseline_year else F.lit(False))
    rows = ranked.withColumn("audit", rl.audit_passage(text, profile)).withColumn(
        "money", mn.relevant_money(mn.money_mentions(text, profile), profile)).withColumn(
        "found", entities(text, finder)).withColumn("stale", stale)
    status = rl.guarded_status(
        F.col("stale"), F.col("audit.polarity"),
        rl.classify_status(text, rl.is_report("url", "title", profile), F.size("money") > 0,
                           profile))
    return rows.withColumn("status", status)


def with_places(rows: DataFrame, keys: list[str], places: DataFrame | None) -> DataFrame:
    """J9, J10 on passages: ``locations`` = streets found, gazetteer names, streets of parcels."""
    if places is None:
        return rows.withColumn("locations", F.col("found.places"))
    named = pl.mentions(rows, keys, "chunk", places)
    lots = pl.resolve_parcels(
        rows.select(*keys, F.try_element_at("found.places", F.lit(1)).alias("first_street"),
                    F.explode("audit.parcels").alias("parcel")), places)
    # a passage is short, so is the list of names in it
    extra = (named.withColumn("_o", F.lit(0)).unionByName(
        lots.filter("street is not null").select(*keys, F.col("street").alias("name"),
                                                 F.lit(1).alias("_o")))
        .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct("_o", "name"))),
                                        lambda s: s["name"]).alias("_names")))
    none = F.array().cast("array<string>")
    return (rows.join(extra, keys, "left").withColumn("locations", rl.merge_entities(
        F.col("found.places"), F.coalesce("_names", none))).drop("_names"))


def contract_changes(run: DataFrame, contracts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(artifacts, changed): the states of the contracts that a run names, from its passages and from
    those of earlier runs, and the evidence (evidence_id), old or new, that names one of them while
    another passage changed it. Both tables are (procurement_id, evidence_id, polarity); contracts
    that the run does not name keep their states and are not looked at."""
    every = run.select("procurement_id", "evidence_id", "polarity")
    if contracts is not None:
        named = every.select("procurement_id").distinct()
        every = every.unionByName(contracts.select(*every.columns).join(named, "procurement_id", "left_semi"))
    every = every.distinct()
    bridge = every.select("procurement_id", "evidence_id").distinct()
    artifacts = artifact_status(bridge, every.select(F.col("evidence_id").alias("id"), "polarity").distinct())
    return artifacts, regressed_evidence(bridge, artifacts)


def judged_again(links: DataFrame, evidence: DataFrame, changed: DataFrame, run: DataFrame) -> DataFrame:
    """Stored links that nobody has reviewed and whose evidence, not found again by the run, names a
    changed contract: (id, suggested_relationship, reasons) as they stand now.

    links(id, evidence_id, suggested_relationship, reasons, review_status), evidence(id, flags,
    polarity)."""
    open_ = links.filter(F.col("review_status") == "unreviewed").join(changed, "evidence_id", "left_semi").join(
        run.select("evidence_id").distinct(), "evidence_id", "left_anti")
    rows = open_.join(evidence.select(F.col("id").alias("evidence_id"), "flags", "polarity"), "evidence_id")
    flags = rl.effective_flags(F.col("flags"), F.lit(True))
    return rows.withColumn("_h", rl.audited_hint(F.col("suggested_relationship"), F.col("reasons"), flags, F.col("polarity"))
                           ).select("id", F.col("_h.relationship").alias("suggested_relationship"), F.col("_h.reasons").alias("reasons"))


def find_evidence(commitments: DataFrame, pages: DataFrame, profile: Profile, *,
                  reviewed: DataFrame | None = None, stored: DataFrame | None = None,
                  places: DataFrame | None = None, baseline_year: int | None = None,
                  provider=rt.HashedVectors, scorer=None, finder=None,
                  eligible: rt.Eligible | None = None, store: str | None = None,
                  sources: DataFrame | None = None, contracts: DataFrame | None = None,
                  budgets: DataFrame | None = None, top: int = TOP_DOCUMENTS) -> dict[str, DataFrame]:
    """Suggested evidence, money, contracts and links of one run.

    commitments(query_id, title, summary, code, deadline_year, chunk); pages(page_id, url,
    title, text, published_year or published_on). ``reviewed(commitment_id, url)`` was decided by a
    person and uses up its place among the first documents; ``stored(id, commitment_id, url)`` are
    known evidence rows, which keep their ids. ``sources``, the registry, repairs titles and names
    publishers. ``contracts(procurement_id, evidence_id, polarity)`` and ``budgets(evidence_id)`` are
    those of earlier runs: a contract cancelled by either side caps the suggestions of both.
    ``changed`` in the result are all evidence rows, earlier ones too, whose contract changed."""
    if "published_on" in pages.columns:
        pages = pages.withColumn("published_year", F.year("published_on"))
    if sources is not None:
        pages = so.repaired_titles(pages, sources)
    best = rank_documents(commitments, pages, profile, provider=provider, scorer=scorer,
                          eligible=eligible, store=store).filter(F.col("doc_rank") <= top).withColumnRenamed(
        "query_id", "commitment_id")
    if reviewed is not None:
        best = best.join(reviewed.select("commitment_id", "url"), ["commitment_id", "url"],
                         "left_anti")
    if sources is not None:
        best = so.publishers(best, sources)
    read = read_passages(best, profile, baseline_year, finder)
    read = with_places(read, ["commitment_id", *KEYS], places)
    if stored is None:
        numbered = with_new_ids(read, ["commitment_id", "url"], 0, "evidence_id")
    else:
        known = stored.select(F.col("id").alias("evidence_id"), "commitment_id", "url")
        last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]  # one number
        old = read.join(known, ["commitment_id", "url"])
        new = read.join(known, ["commitment_id", "url"], "left_anti")
        numbered = old.unionByName(with_new_ids(new, ["commitment_id", "url"], int(last),
                                                "evidence_id"))
    # a run's result: at most ``top`` rows per commitment, read by four tables below
    rows = stage(numbered, "evidence")

    bridge = rows.select(F.explode("audit.procurement_ids").alias("procurement_id"),
                         "evidence_id", F.col("audit.polarity").alias("polarity")).distinct()
    artifacts, changed = contract_changes(bridge, contracts)
    flagged = changed.withColumn("_changed", F.lit(True))
    paid = F.size("money") > 0
    if budgets is not None:
        rows = rows.join(budgets.select("evidence_id", F.lit(True).alias("_paid")).distinct(), "evidence_id", "left")
        paid = paid | F.coalesce("_paid", F.lit(False))

    wanted = commitments.select(
        F.col("query_id").alias("commitment_id"), "deadline_year",
        entities(F.concat_ws(" ", "title", "summary"), finder).alias("named"))
    suffixes = profile.place_drop_suffixes
    base = lambda c: F.array_distinct(F.transform(c, lambda n: tx.norm_place(n, suffixes)))
    year = F.when(F.col("deadline_year").isNotNull(), F.array(F.col("deadline_year").cast(
        "string"))).otherwise(F.array().cast("array<string>"))
    f = mt.features(
        F.col("similarity"),
        (mt.lowered("named.orgs"), mt.lowered("found.orgs")),
        (base(F.col("named.places")), base(F.col("locations"))), (year, F.col("found.dates")))
    scored = (rows.join(wanted, "commitment_id").join(flagged, "evidence_id", "left")
              .withColumn("features", f)
              .withColumn("hint", mt.suggest_relationship(F.col("features"), paid)))
    flags = rl.effective_flags(F.col("audit.flags"), F.col("_changed"))
    scored = scored.withColumn("hint", rl.audited_hint(
        F.col("hint.relationship"), F.col("hint.reasons"), flags, F.col("audit.polarity")))
    old_page = F.concat(F.lit("published "), F.col("published_year").cast("string"), F.lit(
        " — predates the strategy, so it can only be context"))
    reasons = F.when(F.col("stale"), F.array_append("hint.reasons", old_page)).otherwise(
        F.col("hint.reasons"))
    links = scored.select(
        "commitment_id", "evidence_id", "url", "features", mt.match_score(F.col("features"))
        .alias("score"), F.col("hint.relationship").alias("suggested_relationship"),
        reasons.alias("reasons"))
    evidence = rows.select(
        F.col("evidence_id").alias("id"), "commitment_id", "url", "title", "published_year",
        *[c for c in ("published_on", "publisher") if c in rows.columns],
        F.col("chunk").alias("snippet"), F.col("found.orgs").alias("organisations"),
        "locations", F.col("found.dates").alias("dates_mentioned"),
        F.col("status.status").alias("status_hint"),
        F.col("status.excerpt").alias("status_excerpt"), "audit.polarity", "audit.flags",
        "audit.procurement_ids", "audit.parcels")
    money = rows.select("evidence_id", F.explode("money").alias("m"), "url").select(
        "evidence_id", "m.kind", "m.amount_huf", "m.currency", "m.amount_native", "m.amount",
        "m.amount_raw", F.col("m.year").alias("fiscal_year"),
        F.col("m.sentence").alias("description"), F.col("url").alias("source_url"))
    return {"evidence": evidence, "budgets": money, "artifacts": artifacts,
            "artifact_evidence": bridge, "links": links, "changed": changed}

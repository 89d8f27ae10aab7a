"""Passage rules: what one matched passage says about the work it describes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import Profile
from .money import sentence_around
from .text import _col, let

# fixed values: reason texts and relationships a flagged passage may not be hinted at
FLAG_REASONS = {
    "regression_warning":
        "the contract or project was later amended or cancelled, automatic hint blocked",
    "maintenance_only_suspect":
        "repair or maintenance wording without upgrade wording, may not be climate action",
}
CAPPED = ("direct_implementation", "supporting", "budget")
NO_STRINGS = "array<string>"


def has_any(low: Column, cues: Sequence[str]) -> Column:
    """Does a lowercased text hold one of the cues?"""
    if not cues:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in cues])


def polarity(text: Column | str, profile: Profile) -> Column:
    """Termination beats amendment."""
    return let(F.lower(_col(text)), lambda low: (
        F.when(has_any(low, profile.termination_cues), F.lit("termination"))
        .when(has_any(low, profile.amendment_cues), F.lit("amendment"))
        .otherwise(F.lit("affirmative"))))


def maintenance_flags(text: Column | str, profile: Profile) -> Column:
    """Repair talk without any upgrade talk."""
    suspect = lambda low: (has_any(low, profile.maintenance_cues)
                           & ~has_any(low, profile.upgrade_cues))
    return F.when(let(F.lower(_col(text)), suspect), F.array(F.lit("maintenance_only_suspect"))).otherwise(
        F.array().cast(NO_STRINGS))


def jurisdiction(text: Column | str, profile: Profile) -> Column:
    """First owner, in profile order, whose cue shows up."""
    def first(low: Column) -> Column:
        out = F.lit("district_municipality")
        for label, cues in reversed(list(profile.jurisdiction_cues.items())):
            out = F.when(has_any(low, cues), F.lit(label)).otherwise(out)
        return out
    return let(F.lower(_col(text)), first)


def procurement_ids(text: Column | str, profile: Profile) -> Column:
    """Distinct ids in the order they appear."""
    if not profile.procurement_id_re:
        return F.array().cast(NO_STRINGS)
    return F.array_distinct(F.regexp_extract_all(
        _col(text), F.lit("(?iuU)" + profile.procurement_id_re), F.lit(0)))


def parcels(text: Column | str, profile: Profile) -> Column:
    """E5: land-registry numbers; the first filled group of a match, else all of it."""
    if not profile.parcel_re:
        return F.array().cast(NO_STRINGS)
    rx = F.lit("(?iuU)" + profile.parcel_re)
    groups = re.compile(profile.parcel_re).groups
    found = F.struct(*[F.regexp_extract_all(_col(text), rx, F.lit(i)).alias(f"g{i}")
                       for i in range(groups + 1)])
    pick = lambda f: F.transform(f["g0"], lambda whole, i: F.coalesce(
        *[F.nullif(F.element_at(f[f"g{g}"], i + 1), F.lit("")) for g in range(1, groups + 1)],
        whole))
    return F.array_distinct(let(found, pick))


def is_report(url: Column | str, title: Column | str, profile: Profile) -> Column:
    """Broad planning papers, told by file type and report words."""
    return let(F.lower(F.concat_ws(" ", _col(url), _col(title))),
               lambda low: has_any(low, profile.report_cues))


def classify_status(text: Column | str, report: Column, has_money: Column,
                    profile: Profile) -> Column:
    """struct(status, excerpt). Strongest rule first, its first cue decides."""
    cues = [(status, cue) for status, cues in profile.status_rules for cue in cues]
    nothing = F.struct(
        F.when(has_money, F.lit("budget_evidence")).when(report, F.lit("background_only"))
        .otherwise(F.lit("unknown")).alias("status"), F.lit(None).cast("string").alias("excerpt"))
    if not cues:
        return nothing

    def decide(t: Column) -> Column:
        first = F.lit(None).cast("struct<status:string,cue:string>")
        for status, cue in reversed(cues):
            first = F.when(F.contains(t["low"], F.lit(cue)), F.struct(
                F.lit(status).alias("status"), F.lit(cue).alias("cue"))).otherwise(first)
        return let(first, lambda hit: let(F.position(hit["cue"], t["low"]), lambda at: F.when(
            hit.isNotNull(), F.struct(hit["status"].alias("status"), sentence_around(
                F.left(t["text"], at - 1),
                F.substring(t["text"], at, F.length(hit["cue"])),
                F.substring(t["text"], at + F.length(hit["cue"]), F.lit(1 << 30)))
                .alias("excerpt")))))

    read = let(F.struct(_col(text).alias("text"), F.lower(_col(text)).alias("low")), decide)
    return F.coalesce(read, nothing)


def guarded_status(stale: Column, passage_polarity: Column, status: Column) -> Column:
    """An old page is background, a cancelling passage proves nothing."""
    only = lambda s: F.struct(F.lit(s).alias("status"),
                              F.lit(None).cast("string").alias("excerpt"))
    return (F.when(stale, only("background_only"))
            .when(passage_polarity == "termination", only("unknown")).otherwise(status))


def certificate(text: Column | str, profile: Profile) -> Column:
    """The passage mentions a signed handover."""
    return let(F.lower(_col(text)),
               lambda low: has_any(low, profile.completion_certificate_cues))


def audit_passage(text: Column | str, profile: Profile) -> Column:
    """Polarity, flags, ids and parcels in one struct."""
    return F.struct(polarity(text, profile).alias("polarity"),
                    maintenance_flags(text, profile).alias("flags"),
                    procurement_ids(text, profile).alias("procurement_ids"),
                    parcels(text, profile).alias("parcels"))


def cap_hint(relationship: Column, reasons: Column, flags: Column) -> Column:
    """struct(relationship, reasons): a flagged passage is hinted as indirect at most."""
    why = F.create_map(*[F.lit(x) for kv in FLAG_REASONS.items() for x in kv])
    known = F.filter(flags, lambda f: f.isin(*FLAG_REASONS))
    flagged = F.size(known) > 0
    return F.struct(
        F.when(flagged & relationship.isin(*CAPPED), F.lit("related_but_indirect"))
        .otherwise(relationship).alias("relationship"),
        F.concat(reasons, F.transform(known, lambda f: F.element_at(why, f))).alias("reasons"))


def audited_hint(relationship: Column, reasons: Column, flags: Column,
                 passage_polarity: Column) -> Column:
    """A passage that is not affirmative says so and is capped like a flagged one."""
    turned = passage_polarity != "affirmative"
    said = F.when(turned, F.array(F.concat(F.lit("the passage reports a "), passage_polarity,
                                           F.lit(", not progress")))).otherwise(
        F.array().cast(NO_STRINGS))
    warn = F.when(turned, F.array(F.lit("regression_warning"))).otherwise(
        F.array().cast(NO_STRINGS))
    return cap_hint(relationship, F.concat(reasons, said), F.array_union(flags, warn))


def merge_entities(*lists: Column) -> Column:
    """Ordered distinct union."""
    return F.array_distinct(F.concat(*lists))


def effective_flags(flags: Column, regressed: Column) -> Column:
    """A10: stored flags, plus a warning where another passage changed a shared contract."""
    return F.when(F.coalesce(regressed, F.lit(False)), F.array_union(
        flags, F.array(F.lit("regression_warning")))).otherwise(flags)

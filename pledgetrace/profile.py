"""Language profiles: the cue tables behind the passage rules.

A profile is configuration. It is read once, turned into Column literals, and can also be
looked at as a cue table (one row per cue) for joins and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: states money can be in, in output order
BUDGET_KINDS = ("estimated_cost", "initial_appropriation", "amended_appropriation",
                "contracted_price", "actual_expenditure", "reported_expenditure")
STATUSES = ("announced", "planned", "in_preparation", "in_implementation", "completed",
            "budget_evidence", "background_only", "unknown")
JURISDICTIONS = ("district_municipality", "metropolitan_municipality",
                 "public_utility_water", "public_utility_heating", "national_government")
# an older name of the same state
OLD_BUDGET_KINDS = {"approved_allocation": "initial_appropriation"}


@dataclass(frozen=True)
class Profile:
    code: str = ""
    name: str = "unknown"
    currency: str = ""
    currency_words: dict = field(default_factory=dict)
    multiplier_words: dict = field(default_factory=dict)
    decimal_comma: bool = False
    min_amount: int = 0
    budget_cues: dict = field(default_factory=dict)
    completion_certificate_cues: tuple = ()
    termination_cues: tuple = ()
    amendment_cues: tuple = ()
    maintenance_cues: tuple = ()
    upgrade_cues: tuple = ()
    jurisdiction_cues: dict = field(default_factory=dict)
    place_drop_suffixes: tuple = ()
    report_cues: tuple = ()
    status_rules: tuple = ()
    title_stopwords: tuple = ()
    procurement_id_re: str = ""
    parcel_re: str = ""
    form_labels: tuple = ()
    glossary: dict = field(default_factory=dict)


def _check(values, allowed, what: str) -> None:
    bad = [v for v in values if v not in allowed]
    if bad:
        raise ValueError(f"unknown {what}: {bad}")


def make_profile(data: dict) -> Profile:
    """Known keys only; a plain currency list means all local; wrong enum names are errors."""
    known = {f.name for f in fields(Profile)}
    args = {k: v for k, v in data.items() if k in known}
    if isinstance(args.get("currency_words"), list):
        args["currency_words"] = {w: args.get("currency", "") for w in args["currency_words"]}
    if "budget_cues" in args:
        args["budget_cues"] = {OLD_BUDGET_KINDS.get(k, k): tuple(v)
                               for k, v in args["budget_cues"].items()}
        _check(args["budget_cues"], BUDGET_KINDS, "budget kind")
    if "jurisdiction_cues" in args:
        args["jurisdiction_cues"] = {k: tuple(v) for k, v in args["jurisdiction_cues"].items()}
        _check(args["jurisdiction_cues"], JURISDICTIONS, "jurisdiction")
    if "status_rules" in args:
        args["status_rules"] = tuple((s, tuple(cues)) for s, cues in args["status_rules"])
        _check([s for s, _ in args["status_rules"]], STATUSES, "status")
    return Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in args.items()})


def load_profile(text: str) -> Profile:
    return make_profile(json.loads(text))


# cue families whose labels are ranked; the others have one label, the family itself
_LABELLED = ("budget_cues", "jurisdiction_cues")
_PLAIN = ("completion_certificate_cues", "termination_cues", "amendment_cues",
          "maintenance_cues", "upgrade_cues", "report_cues", "place_drop_suffixes",
          "form_labels", "title_stopwords")


def cue_table(profiles: DataFrame) -> DataFrame:
    """profiles(code, profile JSON) -> (code, family, label, label_rank, cue_rank, cue).

    Objects are read as ordered maps, so the order of the JSON is the order of the ranks;
    unknown keys are never looked at and missing ones yield no rows."""
    parts = []
    for fam in _LABELLED:
        entries = F.map_entries(F.from_json(F.get_json_object("profile", f"$.{fam}"),
                                            "map<string,array<string>>"))
        parts.append(profiles.select("code", F.lit(fam).alias("family"),
                                     F.posexplode(entries).alias("label_rank", "e"))
                     .select("code", "family", "label_rank", F.col("e.key").alias("label"),
                             F.posexplode("e.value").alias("cue_rank", "cue")))
    rules = F.from_json(F.get_json_object("profile", "$.status_rules"), "array<array<string>>")
    parts.append(profiles.select("code", F.lit("status_rules").alias("family"),
                                 F.posexplode(rules).alias("label_rank", "e"))
                 .select("code", "family", "label_rank", F.col("e")[0].alias("label"),
                         F.posexplode(F.from_json(F.col("e")[1], "array<string>"))
                         .alias("cue_rank", "cue")))
    for fam in _PLAIN:
        cues = F.from_json(F.get_json_object("profile", f"$.{fam}"), "array<string>")
        parts.append(profiles.select("code", F.lit(fam).alias("family"),
                                     F.lit(0).alias("label_rank"), F.lit(fam).alias("label"),
                                     F.posexplode(cues).alias("cue_rank", "cue")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("code", "family", "label", "label_rank", "cue_rank", "cue")


def glossary_rows(profiles: DataFrame) -> DataFrame:
    """(code, term, meaning)."""
    entries = F.from_json(F.get_json_object("profile", "$.glossary"), "map<string,string>")
    return profiles.select("code", F.explode(entries).alias("term", "meaning"))


def profile_frame(spark: SparkSession, data: dict) -> DataFrame:
    return spark.createDataFrame([(data["code"], json.dumps(data, ensure_ascii=False))],
                                 "code string, profile string")


# fixed values: the English profile
ENGLISH_DATA = {
    "code": "en",
    "name": "English",
    "currency_words": {"GBP": "GBP", "£": "GBP", "pounds": "GBP", "EUR": "EUR", "€": "EUR",
                       "euros": "EUR", "USD": "USD", "$": "USD", "dollars": "USD"},
    "multiplier_words": {"billion": 1000000000, "bn": 1000000000, "million": 1000000,
                         "m": 1000000, "thousand": 1000, "k": 1000},
    "decimal_comma": False,
    "budget_cues": {
        "estimated_cost": ["estimated cost", "expected cost", "planned cost", "projected cost",
                           "budgeted"],
        "actual_expenditure": ["final accounts", "outturn", "actual expenditure",
                               "audited expenditure"],
        "contracted_price": ["contract value", "contract price", "contracted for",
                             "awarded contract"],
        "amended_appropriation": ["revised budget", "amended budget", "budget amendment",
                                  "reallocated"],
        "initial_appropriation": ["approved funding", "granted", "grant of", "allocated",
                                  "funding approved", "awarded", "budget allocation",
                                  "funding secured", "earmarked", "appropriation"],
        "reported_expenditure": ["spent", "expenditure", "paid out", "disbursed",
                                 "cost incurred", "spent to date"],
    },
    "completion_certificate_cues": ["completion certificate", "handover certificate",
                                    "practical completion"],
    "termination_cues": ["cancelled", "canceled", "terminated", "withdrawn", "abandoned",
                         "contract ended early"],
    "amendment_cues": ["contract amendment", "amended contract", "variation order",
                       "rescheduled", "postponed", "scope reduced"],
    "maintenance_cues": ["repair", "pothole", "maintenance", "burst pipe", "patching"],
    "upgrade_cues": ["retrofit", "reconstruction", "renovation", "upgrade", "insulation",
                     "solar", "green roof", "new pipe", "replacement"],
    "jurisdiction_cues": {},
    "place_drop_suffixes": [],
    "report_cues": [".pdf", "report", "strategy", "action plan", "study", "annex", "draft",
                    "plan 20", "framework", "white paper", "consultation"],
    "status_rules": [
        ["completed", ["completed", "finished", "opened", "delivered", "inaugurated",
                       "was built", "has been built", "installed", "planted", "implemented",
                       "unveiled"]],
        ["in_implementation", ["under construction", "underway", "works are ongoing",
                               "construction started", "implementation in progress",
                               "being built", "work has begun", "in progress"]],
        ["in_preparation", ["in planning", "design phase", "under consultation",
                            "preparatory work", "permitting", "public consultation",
                            "being designed", "in preparation"]],
        ["announced", ["announced", "call for proposals", "tender published",
                       "call for tenders", "programme launched", "program launched",
                       "applications open", "open call"]],
        ["planned", ["planned", "proposed", "is envisaged", "scheduled",
                     "will be implemented", "earmarked for"]],
    ],
    "title_stopwords": ["-", "a", "an", "and", "download", "downloads", "for", "in", "of", "on",
                        "pdf", "the", "to", "–"],
    "currency": "GBP",
    "min_amount": 100,
    "procurement_id_re": r"\b(?:ocds-[a-z0-9]{6}-[\w-]+|CF-\d{4}-\d{6,})\b",
}
ENGLISH = make_profile(ENGLISH_DATA)

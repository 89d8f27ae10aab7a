"""The audit trail: what reviewed evidence proves about each commitment.

Everything is a partial aggregate on its way to one summary row per commitment, so a
commitment holding a large share of all evidence costs no single task its size. The lists a
trail shows (evidence, money, regressed passages) stay tables keyed by commitment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as rl
from ..profile import BUDGET_KINDS, Profile

# fixed values: lifecycle order, severity order, finding and gap texts
LIFECYCLE = ("unknown", "announced", "planned", "in_preparation", "in_implementation",
             "completed")
SEVERITY = {"affirmative": ("active", 0), "amendment": ("amended", 1),
            "termination": ("terminated", 2)}
APPROPRIATIONS = ("amended_appropriation", "initial_appropriation")
ONLY_REPORTED = "Spending is only reported, not confirmed by the final accounts."
NOT_CONFIRMED = ("Money was appropriated but no final accounts figure or completion certificate "
                 "confirms it was spent.")
REGRESSED = ("A contract or project behind the implementation evidence was later amended or "
             "cancelled: ")
NO_EVIDENCE, NOT_COMPLETED = "No implementation evidence found yet.", "No completion evidence found."
NO_TARGET, NO_BUDGET = "No measurable target was stated.", "No confirmed budget found."
BUCKETS = {"direct_implementation": "Implementation", "budget": "Budget",
           "probably_unrelated": "Probably unrelated"}


def _choose(c: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def artifact_status(bridge: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per contract the most severe state and the first passage that reached it
    (lowest id); an active contract has none."""
    joined = bridge.join(evidence.select(F.col("id").alias("evidence_id"), "polarity"),
                         "evidence_id")
    # one plain minimum per state: a hash aggregate over two numbers
    first = lambda p: F.min(F.when(F.col("polarity") == p, F.col("evidence_id")))
    worst = joined.groupBy("procurement_id").agg(first("termination").alias("t"),
                                                 first("amendment").alias("a"))
    status = (F.when(F.col("t").isNotNull(), F.lit(SEVERITY["termination"][0]))
              .when(F.col("a").isNotNull(), F.lit(SEVERITY["amendment"][0]))
              .otherwise(F.lit(SEVERITY["affirmative"][0])))
    return worst.select("procurement_id", status.alias("status"),
                        F.coalesce("t", "a").alias("status_evidence_id"))


def regressed_evidence(bridge: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Evidence naming a contract that another passage changed."""
    changed = artifacts.filter(F.col("status") != "active")
    return (bridge.join(changed, "procurement_id")
            .filter(F.col("status_evidence_id").isNull()
                    | (F.col("status_evidence_id") != F.col("evidence_id")))
            .select("evidence_id").distinct())


def with_effective_flags(evidence: DataFrame, bridge: DataFrame, artifacts: DataFrame
                         ) -> DataFrame:
    """A10: evidence with its flags as they stand now."""
    changed = regressed_evidence(bridge, artifacts).select(
        F.col("evidence_id").alias("id"), F.lit(True).alias("_changed"))
    return (evidence.join(changed, "id", "left")
            .withColumn("flags", rl.effective_flags(F.col("flags"), F.col("_changed")))
            .drop("_changed"))


def accepted_pairs(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Accepted links with their evidence; a link without evidence is left out. The suggested
    relationship holds where the reviewer set none."""
    relationship = F.col("relationship")
    if "suggested_relationship" in links.columns:
        relationship = F.coalesce(F.nullif(relationship, F.lit("")), "suggested_relationship")
    l = links.filter(F.col("review_status") == "accepted").select(
        F.col("id").alias("link_id"), "commitment_id", "evidence_id", "score",
        relationship.alias("relationship"))
    return l.join(evidence.withColumnRenamed("id", "evidence_id").drop("commitment_id", "score"),
                  "evidence_id")


def figure(budgets: DataFrame) -> tuple[Column, Column]:
    """(amount, its decimals): as the page wrote it where that is stored as ``amount_native``, else
    without trailing zeros; the forint amount where no other is stored."""
    amount = F.col("amount")
    if "amount_huf" in budgets.columns:
        amount = F.coalesce(amount.cast("decimal(38,6)"), F.col("amount_huf").cast("decimal(38,6)"))
    decimals = lambda text: F.length(F.regexp_extract(text, r"\.(\d+)\z", 1))
    plain = decimals(F.regexp_replace(amount.cast("decimal(38,6)").cast("string"), r"\.?0+\z", ""))
    if "amount_native" in budgets.columns:
        return amount, F.coalesce(decimals(F.col("amount_native")), plain)
    return amount, plain


def deduped_budgets(pairs: DataFrame, budgets: DataFrame) -> DataFrame:
    """A2: per commitment one figure per (wording, currency, kind, source): the one that comes
    first going down the accepted links by score."""
    place = F.struct((-F.col("score")).alias("s"), "link_id", F.col("id").alias("budget_id"))
    rows = pairs.select("commitment_id", "evidence_id", "link_id", "score").join(
        budgets, "evidence_id")
    amount, scale = figure(budgets)
    rows = rows.withColumn("amount", amount).withColumn("scale", scale)
    kept = F.struct("id", "evidence_id", "amount", "scale", "fiscal_year")
    return (rows.groupBy("commitment_id", "amount_raw", "currency", "kind", "source_url")
            .agg(F.min_by(kept, place).alias("b"))
            .select("commitment_id", "amount_raw", "currency", "kind", "source_url", "b.*"))


def states_of(has: dict[str, Column]) -> Column:
    """A3: kinds on record, in their fixed order."""
    return F.array_compact(F.array(*[F.when(has[k], F.lit(k)) for k in BUDGET_KINDS]))


def spaced(value: Column, scale: Column | int) -> Column:
    """A number with spaces between its thousands and ``scale`` decimals."""
    text = F.abs(value).cast("decimal(38,6)").cast("string")
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=\d)(?=(?:\d{3})+\z)", " ")
    scale = F.lit(scale) if isinstance(scale, int) else scale
    return F.when(scale == 0, whole).otherwise(
        F.concat(whole, F.lit("."), F.left(F.substring_index(text, ".", -1), scale)))


def unspent(budgets: DataFrame) -> DataFrame:
    """A5: (commitment_id, fiscal_year, currency, planned, spent, line): the newest appropriation
    against the final accounts of the same year and currency, in the decimals of the figures."""
    if "scale" not in budgets.columns:
        amount, scale = figure(budgets)
        budgets = budgets.withColumn("amount", amount).withColumn("scale", scale)
    of = lambda k: F.max(F.when(F.col("kind") == k, F.struct(
        F.greatest(F.col("amount"), F.lit(0)).alias("amount"), "scale")))
    per = (budgets.filter(F.col("amount").isNotNull() & F.col("fiscal_year").isNotNull())
           .groupBy("commitment_id", "fiscal_year", "currency")
           .agg(F.coalesce(*[of(k) for k in APPROPRIATIONS]).alias("p"),
                of("actual_expenditure").alias("s")))
    planned, spent = F.col("p.amount"), F.col("s.amount")
    line = F.concat(
        F.col("fiscal_year").cast("string"), F.lit(": "),
        spaced(planned - spent, F.greatest("p.scale", "s.scale")), F.lit(" "), F.col("currency"),
        F.lit(" of the appropriation was not spent ("), spaced(spent, F.col("s.scale")),
        F.lit(" of "), spaced(planned, F.col("p.scale")), F.lit(")."))
    return per.filter((planned > 0) & (spent < planned)).select(
        "commitment_id", "fiscal_year", "currency", planned.alias("planned"), spent.alias("spent"),
        line.alias("line"))


def money_rollup(budgets: DataFrame) -> DataFrame:
    """A3-A6 per commitment from its deduped figures. Unspent lines are at most one per year
    and currency."""
    has = {k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)) for k in BUDGET_KINDS}
    kinds = budgets.groupBy("commitment_id").agg(
        F.count("*").alias("n_budgets"), states_of(has).alias("financial_states"))
    lines = unspent(budgets).groupBy("commitment_id").agg(
        F.array_sort(F.collect_list(F.struct("fiscal_year", "currency", "line"))).alias("u"))
    return kinds.join(lines, "commitment_id", "left").select(
        "commitment_id", "n_budgets", "financial_states",
        F.coalesce(F.transform("u", lambda x: x["line"]), F.array().cast("array<string>"))
        .alias("unspent_lines"))


def money_findings(states: Column, executed: Column, lines: Column) -> Column:
    """What the money states leave open, in a fixed order."""
    holds = lambda k: F.array_contains(states, k)
    appropriated = holds(APPROPRIATIONS[0]) | holds(APPROPRIATIONS[1])
    open_ = F.array_compact(F.array(
        F.when(holds("reported_expenditure") & ~holds("actual_expenditure"),
               F.lit(ONLY_REPORTED)),
        F.when(appropriated & ~executed, F.lit(NOT_CONFIRMED))))
    return F.concat(open_, lines)


def pair_rollup(pairs: DataFrame, profile: Profile) -> DataFrame:
    """A4, A7, A8 inputs per commitment from its accepted evidence (effective flags)."""
    direct = F.col("relationship") == "direct_implementation"
    regressed = direct & F.array_contains("flags", "regression_warning")
    rank = _choose(F.col("status_hint"), {s: i for i, s in enumerate(LIFECYCLE)}, -1)
    moves = direct & ~regressed & (rank >= 0)
    best = F.max(F.when(moves, F.struct(
        rank.alias("rank"), F.col("score").alias("score"), (-F.col("link_id")).alias("neg"),
        "status_hint", "status_excerpt"))).alias("best")
    yes = lambda c: F.count(F.when(c, 1))
    return pairs.groupBy("commitment_id").agg(
        F.count("*").alias("n_evidence"), yes(direct).alias("n_direct"),
        yes(direct & (F.col("status_hint") == "completed")).alias("n_completed"),
        yes(regressed).alias("n_regressed"), best,
        F.bool_or(rl.certificate("snippet", profile)).alias("certificate"))


def gaps(n_direct: Column, n_completed: Column, target: Column, n_budgets: Column) -> Column:
    """What is still missing."""
    return F.array_compact(F.array(
        F.when(n_direct == 0, F.lit(NO_EVIDENCE)).when(n_completed == 0, F.lit(NOT_COMPLETED)),
        F.when(target.isNull(), F.lit(NO_TARGET)), F.when(n_budgets == 0, F.lit(NO_BUDGET))))


def trail(commitments: DataFrame, links: DataFrame, evidence: DataFrame, budgets: DataFrame,
          bridge: DataFrame, profile: Profile) -> DataFrame:
    """One row per commitment, also for those without evidence.

    Its evidence, money and regressed passages are accepted_pairs, deduped_budgets and
    regression_findings of the same inputs."""
    current = with_effective_flags(evidence, bridge, artifact_status(bridge, evidence))
    pairs = accepted_pairs(links, current)
    people = pair_rollup(pairs, profile)
    money = money_rollup(deduped_budgets(pairs, budgets))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    none = F.array().cast("array<string>")
    states = F.coalesce("financial_states", none)
    executed = (F.array_contains(states, "actual_expenditure")
                | F.coalesce("certificate", F.lit(False)))
    known = F.coalesce(F.col("best.rank") > 0, F.lit(False))
    return (commitments.withColumnRenamed("id", "commitment_id")
            .join(people, "commitment_id", "left").join(money, "commitment_id", "left")
            .select("commitment_id", "code", "title",
                    zero("n_evidence").alias("n_evidence"),
                    zero("n_budgets").alias("n_budgets"),
                    F.when(known, F.col("best.status_hint")).otherwise(F.lit("unknown"))
                    .alias("status"),
                    F.when(known, F.col("best.status_excerpt")).alias("status_excerpt"),
                    gaps(zero("n_direct"), zero("n_completed"), F.col("target_value"),
                         zero("n_budgets")).alias("gaps"),
                    states.alias("financial_states"), executed.alias("financially_executed"),
                    money_findings(states, executed, F.coalesce("unspent_lines", none))
                    .alias("findings"),
                    zero("n_regressed").alias("n_regressed")))


def regression_findings(pairs: DataFrame) -> DataFrame:
    """One row per regressed direct passage; a commitment's finding is its rows."""
    return (pairs.filter((F.col("relationship") == "direct_implementation")
                         & F.array_contains("flags", "regression_warning"))
            .select("commitment_id", "score", "link_id", "evidence_id",
                    F.concat(F.lit(REGRESSED), "title", F.lit(".")).alias("finding")))


def bucket(relationship: Column) -> Column:
    """Where a trail shows a piece of evidence."""
    return _choose(relationship, BUCKETS, "Supporting")


def baseline_year(documents: DataFrame, configured: int | None = None) -> DataFrame:
    """A1: the configured year, else the earliest /20YY/MM/ in a document address."""
    year = F.regexp_extract("url", r"/(20\d{2})/\d{2}/", 1)
    found = F.min(F.nullif(year, F.lit("")).cast("int"))
    return documents.agg(F.coalesce(F.lit(configured or None).cast("int"), found)
                         .alias("baseline_year"))


def link_views(links: DataFrame, evidence: DataFrame, budgets: DataFrame, notes: DataFrame
               ) -> DataFrame:
    """Every link with its evidence, how much money it names, and its note. Figures are
    summed up per evidence before they meet the links; the figures themselves join on
    evidence_id."""
    per = budgets.groupBy("evidence_id").agg(F.count("*").alias("n_budgets"),
                                             F.max("amount").alias("top_amount"))
    ev = evidence.withColumnRenamed("id", "evidence_id").drop("commitment_id")
    return (links.join(ev, "evidence_id", "left").join(per, "evidence_id", "left")
            .join(notes.withColumnRenamed("subject_id", "id"), "id", "left")
            .withColumn("n_budgets", F.coalesce("n_budgets", F.lit(0).cast("bigint"))))


def link_figures(links: DataFrame, budgets: DataFrame) -> DataFrame:
    """The figures of every link, one row each with ``link_id``; a page may name any number of
    them, so they stay rows beside ``link_views``."""
    return budgets.join(links.select(F.col("id").alias("link_id"), "evidence_id"), "evidence_id")


# fixed values: what the short form of a link leaves out
WIDE = ("snippet", "status_excerpt", "organisations", "locations", "dates_mentioned")


def lite_views(views: DataFrame) -> DataFrame:
    """Link views without the wide columns; the scan never reads them."""
    return views.drop(*WIDE)

"""Queries: joins around evidence, the audit trail, resets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching  # noqa: F401
from ..operators import reset as rs
from ..operators import retrieval as rt
from ..operators import trail as tr
from ..profile import ENGLISH
from .registry import query
from .texts import frame
from .views import cte, table, view

NO_STRINGS = "array<string>"

# evidence and budgets with the columns the trail needs
EV_SQL = """ev as (select *, split_part(snippet, '. ', 1) || '.' as status_excerpt, id % 7 = 0 as suspect from evidence)"""
BUDGET_SQL = """bu as (select *, currency || ' ' || cast(floor(amount / 20000) as int) as amount_raw, 's' || (evidence_id % 3) as source_url from budgets)"""
ART_SQL = """aj as (select b.procurement_id, b.evidence_id, case e.polarity when 'termination' then 2 when 'amendment' then 1 else 0 end as r from artifact_evidence b join evidence e on e.id = b.evidence_id),
art as (select procurement_id, case r when 2 then 'terminated' when 1 then 'amended' else 'active' end as status, case when r > 0 then evidence_id end as status_evidence_id
 from aj qualify row_number() over (partition by procurement_id order by r desc, evidence_id) = 1),
chg as (select distinct b.evidence_id from artifact_evidence b join art a using (procurement_id) where a.status <> 'active' and a.status_evidence_id <> b.evidence_id),
pairs as (select l.id as link_id, l.commitment_id, l.evidence_id, l.score, coalesce(l.relationship, l.suggested_relationship) as relationship, e.title, e.snippet, e.status_hint, e.status_excerpt, c.evidence_id is not null as regressed
 from links l join ev e on e.id = l.evidence_id left join chg c on c.evidence_id = e.id where l.review_status = 'accepted'),
ded as (select p.commitment_id, b.kind, b.currency, b.amount, case when b.amount_native is null then 0 else 2 end as scale, b.fiscal_year, b.amount_raw, b.source_url, b.id, b.evidence_id from pairs p join bu b using (evidence_id)
 qualify row_number() over (partition by p.commitment_id, b.amount_raw, b.currency, b.kind, b.source_url order by p.score desc, p.link_id, b.id) = 1)"""
AUDIT = cte("commitments", "evidence", "links", "budgets", "artifact_evidence") + ", " + EV_SQL + ", " + BUDGET_SQL + ", " + ART_SQL
UNSPENT_SQL = """, un0 as (select commitment_id, fiscal_year, currency, coalesce(max(struct_pack(a := amount, s := scale)) filter (kind = 'amended_appropriation'), max(struct_pack(a := amount, s := scale)) filter (kind = 'initial_appropriation')) as p, max(struct_pack(a := amount, s := scale)) filter (kind = 'actual_expenditure') as q from ded group by all),
un as (select *, p.a as planned, q.a as spent from un0 where p.a > 0 and q.a < p.a),
ul as (select *, fiscal_year || ': ' || {d} || ' ' || currency || ' of the appropriation was not spent (' || {s} || ' of ' || {p} || ').' as line from un)""".format(
    **{k: f"replace(format('{{:,}}', cast(floor({e}) as bigint)), ',', ' ') || case when {n} = 0 then '' else '.' || right(cast(cast({e} as decimal(18,2)) as varchar), 2) end"
       for k, e, n in (("d", "(planned - spent)", "greatest(p.s, q.s)"), ("s", "spent", "q.s"), ("p", "planned", "p.s"))})
KINDS = ("estimated_cost", "initial_appropriation", "amended_appropriation", "contracted_price",
         "actual_expenditure", "reported_expenditure")
MONEY_SQL = UNSPENT_SQL + """, st as (select commitment_id, count(*) as n_budgets, concat_ws(',', """ + ", ".join(
    f"case when bool_or(kind = '{k}') then '{k}' end" for k in KINDS) + """) as states from ded group by all),
ll as (select commitment_id, string_agg(line, ' ' order by fiscal_year, currency) as lines from ul group by all)"""


def evidence_rows(spark, sf):
    e = view(spark, sf, "evidence").withColumn(
        "status_excerpt", F.concat(F.substring_index("snippet", ". ", 1), F.lit(".")))
    return e.withColumn("flags", F.when(F.col("id") % 7 == 0, F.array(
        F.lit("maintenance_only_suspect"))).otherwise(F.array().cast(NO_STRINGS)))


def budget_rows(spark, sf):
    return view(spark, sf, "budgets").select(
        "*", F.concat("currency", F.lit(" "), F.floor(F.col("amount") / 20000).cast("int")
                      .cast("string")).alias("amount_raw"),
        F.concat(F.lit("s"), (F.col("evidence_id") % 3).cast("string")).alias("source_url"))


def current_pairs(spark, sf):
    ev, bridge = evidence_rows(spark, sf), view(spark, sf, "artifact_evidence")
    now = tr.with_effective_flags(ev, bridge, tr.artifact_status(bridge, ev))
    return tr.accepted_pairs(view(spark, sf, "links"), now)


def deduped(spark, sf):
    return tr.deduped_budgets(tr.accepted_pairs(view(spark, sf, "links"),
                                                evidence_rows(spark, sf)),
                              budget_rows(spark, sf))


@query("J2_accepted_evidence", cte("links", "evidence") + " select l.id as link_id, l.commitment_id, e.id as evidence_id, e.title, e.status_hint from links l join evidence e on e.id = l.evidence_id where l.review_status = 'accepted'")
def j2(spark, sf):
    return tr.accepted_pairs(view(spark, sf, "links"), view(spark, sf, "evidence")).select(
        "link_id", "commitment_id", "evidence_id", "title", "status_hint")


@query("J3_link_views", AUDIT + """, b as (select evidence_id, count(*) as n_budgets, max(amount) as top from bu group by all)
select l.id, l.commitment_id, e.title, cast(coalesce(n_budgets, 0) as bigint) as n_budgets, top as top_amount, case when l.id % 4 = 0 then 'note ' || l.id end as note from links l left join ev e on e.id = l.evidence_id left join b using (evidence_id)""")
def j3(spark, sf):
    notes = view(spark, sf, "links").filter(F.col("id") % 4 == 0).select(
        F.col("id").alias("subject_id"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("note"))
    return tr.link_views(view(spark, sf, "links"), evidence_rows(spark, sf),
                         budget_rows(spark, sf), notes).select(
        "id", "commitment_id", "title", "n_budgets", "top_amount", "note")


@query("J3_link_figures", AUDIT + " select l.id as link_id, l.evidence_id, b.id, b.kind, b.currency, b.amount, b.amount_raw, b.fiscal_year from links l join bu b on b.evidence_id = l.evidence_id")
def j3_figures(spark, sf):
    return tr.link_figures(view(spark, sf, "links"), budget_rows(spark, sf)).select(
        "link_id", "evidence_id", "id", "kind", "currency", "amount", "amount_raw", "fiscal_year")


@query("J11_reviewed_evidence", cte("links") + " select distinct evidence_id from links where review_status <> 'unreviewed'")
def j11(spark, sf):
    from ..operators.merge import reviewed_keys
    return reviewed_keys(view(spark, sf, "links"))


@query("J18_artifact_bridge", AUDIT + " select b.evidence_id, a.procurement_id, a.status from artifact_evidence b join art a using (procurement_id) join evidence e on e.id = b.evidence_id")
def j18(spark, sf):
    ev, bridge = view(spark, sf, "evidence"), view(spark, sf, "artifact_evidence")
    art = tr.artifact_status(bridge, ev)
    return (bridge.join(art, "procurement_id")
            .join(ev.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
            .select("evidence_id", "procurement_id", "status"))


DOC_URLS = "select o_orderkey as id, concat('https://city.example.org/docs/', year(o_orderdate) + 15, '/', lpad(cast(month(o_orderdate) as string), 2, '0'), '/plan.pdf') as url from {orders}"


@query("A1_baseline_year", "select cast(min(year(o_orderdate) + 15) as int) as baseline_year from orders")
def a1(spark, sf):
    return tr.baseline_year(frame(spark, sf, DOC_URLS))


@query("A2_dedupe_budgets", AUDIT + " select commitment_id, amount_raw, currency, kind, source_url, evidence_id, amount from ded")
def a2(spark, sf):
    return deduped(spark, sf).select("commitment_id", "amount_raw", "currency", "kind",
                                     "source_url", "evidence_id", "amount")


@query("A3_financial_states", AUDIT + MONEY_SQL + " select commitment_id, n_budgets, states from st")
def a3(spark, sf):
    return tr.money_rollup(deduped(spark, sf)).select(
        "commitment_id", "n_budgets", F.array_join("financial_states", ",").alias("states"))


@query("A4_executed", AUDIT + MONEY_SQL + """, c as (select commitment_id, bool_or(contains(lower(snippet || case when evidence_id % 6 = 0 then ' Handover certificate.' else '' end), 'handover certificate')) as cert from pairs group by all)
select commitment_id, contains(coalesce(states, ''), 'actual_expenditure') or cert as executed from c left join st using (commitment_id)""")
def a4(spark, sf):
    p = current_pairs(spark, sf).withColumn("snippet", F.concat("snippet", F.when(
        F.col("evidence_id") % 6 == 0, F.lit(" Handover certificate.")).otherwise(F.lit(""))))
    money = tr.money_rollup(tr.deduped_budgets(p, budget_rows(spark, sf)))
    spent = F.array_contains(F.coalesce("financial_states", F.array().cast(NO_STRINGS)),
                             "actual_expenditure")
    return (tr.pair_rollup(p, ENGLISH).join(money, "commitment_id", "left")
            .select("commitment_id", (spent | F.col("certificate")).alias("executed")))


@query("A5_unspent", AUDIT + UNSPENT_SQL + " select commitment_id, fiscal_year, currency, planned, spent, line from ul")
def a5(spark, sf):
    return tr.unspent(deduped(spark, sf)).select("commitment_id", "fiscal_year", "currency",
                                                 "planned", "spent", "line")


FIND_SQL = f"""concat_ws(' ', case when contains(coalesce(states, ''), 'reported_expenditure') and not contains(coalesce(states, ''), 'actual_expenditure') then '{tr.ONLY_REPORTED}' end,
 case when contains(coalesce(states, ''), 'appropriation') and not contains(coalesce(states, ''), 'actual_expenditure') then '{tr.NOT_CONFIRMED}' end, lines)"""


@query("A6_financial_findings", AUDIT + MONEY_SQL + f" select commitment_id, {FIND_SQL} as findings from st left join ll using (commitment_id)")
def a6(spark, sf):
    m = tr.money_rollup(deduped(spark, sf))
    f = tr.money_findings(F.col("financial_states"), F.array_contains(
        "financial_states", "actual_expenditure"), F.col("unspent_lines"))
    return m.select("commitment_id", F.array_join(f, " ").alias("findings"))


BEST_SQL = """, best as (select commitment_id, status_hint as status, status_excerpt from pairs where relationship = 'direct_implementation' and not regressed
 qualify row_number() over (partition by commitment_id order by case status_hint when 'completed' then 5 when 'in_implementation' then 4 when 'planned' then 2 else 0 end desc, score desc, link_id) = 1)"""


@query("A7_best_status", AUDIT + BEST_SQL + " select * from best")
def a7(spark, sf):
    r = tr.pair_rollup(current_pairs(spark, sf), ENGLISH).filter("best is not null")
    return r.select("commitment_id", F.col("best.status_hint").alias("status"),
                    "best.status_excerpt")


GAP_SQL = f"""concat_ws(' ', case when coalesce(n_direct, 0) = 0 then '{tr.NO_EVIDENCE}' when n_completed = 0 then '{tr.NOT_COMPLETED}' end, case when target_value is null then '{tr.NO_TARGET}' end, case when coalesce(n_budgets, 0) = 0 then '{tr.NO_BUDGET}' end)"""
ROLL_SQL = """, pr as (select commitment_id, count(*) as n_evidence, count(*) filter (relationship = 'direct_implementation') as n_direct,
 count(*) filter (relationship = 'direct_implementation' and status_hint = 'completed') as n_completed, count(*) filter (relationship = 'direct_implementation' and regressed) as n_regressed from pairs group by all)"""


@query("A8_gaps", AUDIT + MONEY_SQL + ROLL_SQL + f" select c.id as commitment_id, {GAP_SQL} as gaps from commitments c left join pr on pr.commitment_id = c.id left join st on st.commitment_id = c.id")
def a8(spark, sf):
    return full_trail(spark, sf).select("commitment_id", F.array_join("gaps", " ").alias("gaps"))


def full_trail(spark, sf):
    return tr.trail(view(spark, sf, "commitments"), view(spark, sf, "links"),
                    evidence_rows(spark, sf), budget_rows(spark, sf),
                    view(spark, sf, "artifact_evidence"), ENGLISH)


@query("A9_artifact_status", AUDIT + " select * from art")
def a9(spark, sf):
    return tr.artifact_status(view(spark, sf, "artifact_evidence"), view(spark, sf, "evidence"))


@query("A10_effective_flags", AUDIT + """ select ev.id, concat_ws(',', case when suspect then 'maintenance_only_suspect' end, case when chg.evidence_id is not null then 'regression_warning' end) as flags from ev left join chg on chg.evidence_id = ev.id""")
def a10(spark, sf):
    ev, bridge = evidence_rows(spark, sf), view(spark, sf, "artifact_evidence")
    now = tr.with_effective_flags(ev, bridge, tr.artifact_status(bridge, ev))
    return now.select("id", F.array_join("flags", ",").alias("flags"))


@query("A11_regression_finding", AUDIT + f" select commitment_id, evidence_id, '{tr.REGRESSED}' || title || '.' as finding from pairs where relationship = 'direct_implementation' and regressed")
def a11(spark, sf):
    return tr.regression_findings(current_pairs(spark, sf)).select(
        "commitment_id", "evidence_id", "finding")


@query("A12_trail", AUDIT + MONEY_SQL + BEST_SQL + ROLL_SQL + f"""
select c.id as commitment_id, c.code, c.title, cast(coalesce(n_evidence, 0) as bigint) as n_evidence, cast(coalesce(n_budgets, 0) as bigint) as n_budgets, coalesce(best.status, 'unknown') as status, best.status_excerpt,
 {GAP_SQL} as gaps, coalesce(states, '') as financial_states, contains(coalesce(states, ''), 'actual_expenditure') as financially_executed, {FIND_SQL} as findings, cast(coalesce(n_regressed, 0) as bigint) as n_regressed
from commitments c left join pr on pr.commitment_id = c.id left join st on st.commitment_id = c.id left join ll on ll.commitment_id = c.id left join best on best.commitment_id = c.id""")
def a12(spark, sf):
    joined = lambda c, s: F.array_join(c, s).alias(c)
    return full_trail(spark, sf).select(
        "commitment_id", "code", "title", "n_evidence", "n_budgets", "status", "status_excerpt",
        joined("gaps", " "), joined("financial_states", ","), "financially_executed",
        joined("findings", " "), "n_regressed")


@query("A16_trail_buckets", AUDIT + """, b as (select commitment_id, case relationship when 'direct_implementation' then 'Implementation' when 'budget' then 'Budget' when 'probably_unrelated' then 'Probably unrelated' else 'Supporting' end as bucket from pairs)
select commitment_id, bucket, count(*) as n from b group by all""")
def a16(spark, sf):
    p = current_pairs(spark, sf)
    return p.groupBy("commitment_id", tr.bucket(F.col("relationship")).alias("bucket")).agg(
        F.count("*").alias("n"))


@query("T4_top_then_skip", cte("links") + """, r as (select *, row_number() over (partition by commitment_id order by score desc, id) as rank from links qualify rank <= 5)
select commitment_id, evidence_id, cast(rank as int) as rank from r where review_status = 'unreviewed'""")
def t4(spark, sf):
    links = view(spark, sf, "links")
    top = rt.top_per(links, ["commitment_id"], [F.desc("score"), F.col("id")], 5)
    decided = links.filter("review_status <> 'unreviewed'").select("evidence_id")
    return top.join(decided, "evidence_id", "left_anti").select("commitment_id", "evidence_id", "rank")


@query("T8_budget_head", AUDIT + """ select commitment_id, kind, amount, cast(r as int) as rank, cast(n - 6 as bigint) as more from (
 select *, row_number() over (partition by commitment_id order by amount desc, kind, evidence_id, id) as r, count(*) over (partition by commitment_id) as n from ded) where r <= 6""")
def t8(spark, sf):
    d = deduped(spark, sf)
    size = d.groupBy("commitment_id").agg((F.count("*") - 6).alias("more"))
    top = rt.top_per(d, ["commitment_id"], [F.desc("amount"), F.col("kind"),
                                            F.col("evidence_id"), F.col("id")], 6)
    return top.join(size, "commitment_id").select("commitment_id", "kind", "amount", "rank", "more")


# -- reset -----------------------------------------------------------------------------------

RESET = AUDIT + """, cand as (select c_custkey as id, case when c_custkey % 3 = 0 then 'accepted' else 'unreviewed' end as review_status from customer),
com as (select c_custkey + 1000000 as id, c_custkey as candidate_id from customer where c_acctbal > 0),
nt as (select 'link' as subject_kind, id as subject_id from links union all select 'candidate', id from cand),
dec as (select distinct evidence_id from links where review_status <> 'unreviewed'),
b_out as (select evidence_id, id from bu where evidence_id not in (select evidence_id from dec)),
l_out as (select id from links where review_status = 'unreviewed'),
held as (select evidence_id from dec),
br_out as (select * from artifact_evidence where evidence_id not in (select evidence_id from held)),
br_left as (select * from artifact_evidence where evidence_id in (select evidence_id from held)),
moved as (select procurement_id from art where status_evidence_id is not null and status_evidence_id not in (select evidence_id from held)),
again as (select distinct b.procurement_id from br_left b join evidence e on e.id = b.evidence_id where e.polarity <> 'affirmative' and b.procurement_id in (select procurement_id from moved)),
orph as (select procurement_id from art where procurement_id not in (select procurement_id from br_left)),
e_out as (select id from evidence where id not in (select evidence_id from held)),
c_out as (select id from cand where review_status = 'unreviewed' and id not in (select candidate_id from com)),
n_out as (select * from nt where (subject_kind = 'link' and subject_id in (select id from l_out)) or (subject_kind = 'candidate' and subject_id in (select id from c_out)))"""


def stored_tables(spark, sf):
    c = table(spark, sf, "customer")
    cand = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "accepted")
                    .otherwise("unreviewed").alias("review_status"))
    com = c.filter("c_acctbal > 0").select((F.col("c_custkey") + 1000000).alias("id"),
                                           F.col("c_custkey").alias("candidate_id"))
    links, ev = view(spark, sf, "links"), view(spark, sf, "evidence")
    note = lambda df, kind: df.select(F.lit(kind).alias("subject_kind"),
                                      F.col("id").alias("subject_id"))
    bridge = view(spark, sf, "artifact_evidence")
    return {"links": links, "evidence": ev, "budgets": budget_rows(spark, sf),
            "artifact_evidence": bridge, "artifacts": tr.artifact_status(bridge, ev),
            "candidates": cand, "commitments": com,
            "notes": note(links, "link").unionByName(note(cand, "candidate"))}


@query("J12_reset_cascade", RESET + " select id as evidence_id from e_out")
def j12(spark, sf):
    return rs.generated(stored_tables(spark, sf))["evidence"][0].select(
        F.col("id").alias("evidence_id"))


@query("A17_reset_counts", RESET + """ select 'budgets' as "table", count(*) as n from b_out union all select 'links', count(*) from l_out union all select 'artifact_evidence', count(*) from br_out
union all select 'implementation_artifacts', (select count(*) from moved) + (select count(*) from again) + (select count(*) from orph) union all select 'evidence', count(*) from e_out union all select 'candidates', count(*) from c_out union all select 'notes', count(*) from n_out""")
def a17(spark, sf):
    return rs.reset_counts(stored_tables(spark, sf))


@query("J13_without_note", RESET + """, have as (select id as subject_id from links where id % 4 = 0)
select 'candidate' as subject_kind, id as subject_id from cand where review_status = 'unreviewed'
union all select 'link', l.id from links l where review_status = 'unreviewed' and l.commitment_id in (select id from commitments) and l.evidence_id in (select id from evidence) and l.id not in (select subject_id from have)""")
def j13(spark, sf):
    t = stored_tables(spark, sf)
    notes = t["links"].filter(F.col("id") % 4 == 0).select(
        F.lit("link").alias("subject_kind"), F.col("id").alias("subject_id"))
    return rs.without_note(t["candidates"], t["links"], t["evidence"],
                           view(spark, sf, "commitments"), notes)

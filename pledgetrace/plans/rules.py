"""Queries: passage rules, money, status, hints, over rendered passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as mn
from ..functions import rules as rl
from ..functions import text as tx
from ..operators import matching as mt
from ..profile import ENGLISH, make_profile
from ..session import spread
from .registry import query
from .texts import frame
from .views import cte, table, view

# small profiles for rules the English one leaves empty
OWNERS = make_profile({"jurisdiction_cues": {"public_utility_water": ["building"],
                                             "metropolitan_municipality": ["automobile",
                                                                           "building"]}})
PARCELS = make_profile({"parcel_re": r"\b(\d{4,6}/\d+)\s*lot\b|\blot:?\s*(\d{4,6}/\d+)"})

KIND_SQL = """case o_orderpriority when '1-URGENT' then 'estimated_cost' when '2-HIGH' then 'actual_expenditure'
 when '3-MEDIUM' then 'contracted_price' when '4-NOT SPECIFIED' then 'amended_appropriation' else 'initial_appropriation' end"""
STATUS_SQL = """case o_orderstatus when 'F' then 'completed' when 'O' then 'in_implementation' else 'planned' end"""


def evidence(spark, sf):
    return spread(view(spark, sf, "evidence"))


@query("E1_polarity", cte("evidence") + " select id, polarity from evidence")
def e1(spark, sf):
    return evidence(spark, sf).select("id", rl.polarity("snippet", ENGLISH).alias("polarity"))


REPAIRS = "select p_partkey as id, concat('Repair of the ', p_name, case when p_size > 25 then ' and full Replacement' else '' end) as t from {part}"


@query("E2_maintenance_flag", "select p_partkey as id, case when p_size > 25 then '' else 'maintenance_only_suspect' end as flags from part")
def e2(spark, sf):
    return frame(spark, sf, REPAIRS).select("id", F.array_join(
        rl.maintenance_flags("t", ENGLISH), ",").alias("flags"))


@query("E3_jurisdiction", """select c_custkey as id, case c_mktsegment when 'BUILDING' then 'public_utility_water' when 'AUTOMOBILE' then 'metropolitan_municipality' else 'district_municipality' end as owner from customer""")
def e3(spark, sf):
    t = F.concat(F.lit("Renewal of "), F.col("c_mktsegment"), F.lit(" assets"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                               rl.jurisdiction(t, OWNERS).alias("owner"))


IDS = """select l_orderkey as id, l_linenumber as n, concat('Under CF-2024-', lpad(cast(l_partkey as string), 6, '0'), ' and cf-2023-', lpad(cast(l_suppkey as string), 6, '0'), ', again CF-2024-', lpad(cast(l_partkey as string), 6, '0'), '; not XCF-2024-000001 or CF-24-1.') as t from {lineitem}"""


@query("E4_procurement_ids", "select l_orderkey as id, l_linenumber as n, 'CF-2024-' || lpad(l_partkey::varchar, 6, '0') || ',cf-2023-' || lpad(l_suppkey::varchar, 6, '0') as ids from lineitem")
def e4(spark, sf):
    return frame(spark, sf, IDS).select("id", "n", F.array_join(
        rl.procurement_ids("t", ENGLISH), ",").alias("ids"))


@query("E5_parcels", "select o_orderkey as id, (10000 + o_custkey) || '/1,' || (20000 + o_orderkey % 7000) || '/2' as parcels from orders")
def e5(spark, sf):
    t = frame(spark, sf, "select o_orderkey as id, concat('The square (', 10000 + o_custkey, '/1 lot) and lot: ', 20000 + o_orderkey % 7000, '/2, LOT ', 10000 + o_custkey, '/1') as t from {orders}")
    return t.select("id", F.array_join(rl.parcels("t", PARCELS), ",").alias("parcels"))


MONEY_SQL = f"""select o_orderkey as id, cast(0 as int) as pos, '£' || cast(o_totalprice as decimal(18,2))::varchar as amount_raw, 'GBP' as currency,
 cast(o_totalprice as decimal(18,2))::varchar as amount_native, cast(cast(o_totalprice as decimal(18,2)) as decimal(38,6)) as amount, {KIND_SQL} as kind, cast(year(o_orderdate) as int) as year,
 regexp_extract(snippet, '^[^.]*[.][0-9]+[.]') as sentence from orders join evidence e on e.id = o_orderkey"""


@query("E6_extract_money", cte("evidence") + MONEY_SQL)
def e6(spark, sf):
    m = evidence(spark, sf).select("id", F.posexplode(mn.money_mentions("snippet", ENGLISH))
                                   .alias("pos", "m"))
    return m.select("id", "pos", *[F.col(f"m.{c}") for c in (
        "amount_raw", "currency", "amount_native", "amount", "kind", "year", "sentence")])


AMOUNTS = """select l_orderkey as id, l_linenumber as n, concat('It paid out ', cast(l_quantity as int), case l_linenumber % 3 when 0 then '.50 Million EUR' when 1 then ',000 pounds' else ' 250 k$' end, ' so far. Next') as t from {lineitem}"""


@query("E7_amount", """select l_orderkey as id, l_linenumber as n, case l_linenumber % 3 when 0 then l_quantity::int || '500000.00' when 1 then l_quantity::int || '000' else l_quantity::int || '250000' end as amount_native,
 case l_linenumber % 3 when 0 then 'EUR' when 1 then 'GBP' else 'USD' end as currency, 'reported_expenditure' as kind from lineitem""")
def e7(spark, sf):
    m = mn.money_mentions("t", ENGLISH)
    return frame(spark, sf, AMOUNTS).select("id", "n", F.explode(m).alias("m")).select(
        "id", "n", "m.amount_native", "m.currency", "m.kind")


@query("E8_sentence_around", cte("evidence") + " select id, 'Works are ' || case status_hint when 'completed' then 'completed' when 'in_implementation' then 'underway' else 'scheduled' end || '.' as sentence from evidence")
def e8(spark, sf):
    at = F.locate("Works", F.col("snippet"))
    s = mn.sentence_around(F.left("snippet", at - 1), F.lit("Works"),
                           F.substring(F.col("snippet"), at + 5, F.lit(4000)))
    return evidence(spark, sf).select("id", s.alias("sentence"))


@query("E9_budget_kind", cte("evidence") + f" select o_orderkey as id, {KIND_SQL} as kind, cast(year(o_orderdate) as int) as fiscal_year from orders")
def e9(spark, sf):
    first = F.concat(F.substring_index("snippet", ". ", 1), F.lit("."))
    return evidence(spark, sf).select("id", mn.budget_kind(first, ENGLISH).alias("kind"),
                                      tx.first_year(first).alias("fiscal_year"))


@query("E10_currency", "select l_orderkey as id, l_linenumber as n, case l_linenumber when 1 then 'EUR' when 2 then 'USD' else 'GBP' end as currency from lineitem")
def e10(spark, sf):
    w = F.when(F.col("l_linenumber") == 1, "EUROS").when(F.col("l_linenumber") == 2, "$").when(
        F.col("l_linenumber") == 3, "Pounds").otherwise("shillings")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"),
        mn.currency_of(w, ENGLISH).alias("currency"))


@query("E11_relevant_money", cte("evidence") + f""" select o_orderkey as id, cast(1 as int) as n, cast(o_totalprice as decimal(18,2))::varchar as amount_native, {KIND_SQL} as kind from orders where o_totalprice >= 100""")
def e11(spark, sf):
    t = F.concat("snippet", F.lit("\nOnly £99 was budgeted. "), F.lit("Some £5,000 came. \n"),
                 "snippet")
    kept = mn.relevant_money(mn.money_mentions(t, ENGLISH), ENGLISH)
    return evidence(spark, sf).select("id", kept.alias("k")).select(
        "id", F.size("k").alias("n"), F.col("k")[0]["amount_native"].alias("amount_native"),
        F.col("k")[0]["kind"].alias("kind"))


@query("E12_classify_status", cte("evidence") + """ select id, status_hint as status, 'Works are ' || case status_hint when 'completed' then 'completed' when 'in_implementation' then 'underway' else 'scheduled' end || '.' as excerpt from evidence""")
def e12(spark, sf):
    s = rl.classify_status("snippet", F.lit(False), F.lit(True), ENGLISH)
    return evidence(spark, sf).select("id", s.alias("s")).select("id", "s.status", "s.excerpt")


@query("E13_is_report", "select o_orderkey as id, o_orderkey % 3 < 2 as is_report from orders")
def e13(spark, sf):
    e = evidence(spark, sf)
    url = F.when(F.col("id") % 3 == 0, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    title = F.when(F.col("id") % 3 == 1, F.lit("Annual Report")).otherwise(F.col("title"))
    return e.select("id", rl.is_report(url, title, ENGLISH).alias("is_report"))


@query("E14_status_guard", cte("evidence") + """ select id, case when published_year < 1996 then 'background_only' when polarity = 'termination' then 'unknown' else status_hint end as status,
 case when published_year >= 1996 and polarity <> 'termination' then 'Works are ' || case status_hint when 'completed' then 'completed' when 'in_implementation' then 'underway' else 'scheduled' end || '.' end as excerpt from evidence""")
def e14(spark, sf):
    s = rl.guarded_status(F.col("published_year") < 1996, rl.polarity("snippet", ENGLISH),
                          rl.classify_status("snippet", F.lit(False), F.lit(True), ENGLISH))
    return evidence(spark, sf).select("id", s.alias("s")).select("id", "s.status", "s.excerpt")


@query("E15_completion_certificate", cte("evidence", "links") + """ select l.commitment_id, bool_or(e.id % 6 = 0) as certificate from links l join evidence e on e.id = l.evidence_id where l.review_status = 'accepted' group by all""")
def e15(spark, sf):
    text = F.concat("snippet", F.when(F.col("evidence_id") % 6 == 0, F.lit(
        " A Completion Certificate was signed.")).otherwise(F.lit("")))
    e = evidence(spark, sf).select(F.col("id").alias("evidence_id"), "snippet")
    accepted = view(spark, sf, "links").filter("review_status = 'accepted'")
    return (accepted.join(e, "evidence_id").groupBy("commitment_id")
            .agg(F.bool_or(rl.certificate(text, ENGLISH)).alias("certificate")))


@query("E16_audit_passage", cte("evidence") + """ select id, polarity, 'maintenance_only_suspect' as flags, 'CF-2024-' || lpad(id::varchar, 6, '0') as ids, '' as parcels from evidence""")
def e16(spark, sf):
    t = F.concat("snippet", F.lit(" Patching under CF-2024-"),
                 F.lpad(F.col("id").cast("string"), 6, "0"))
    a = evidence(spark, sf).select("id", rl.audit_passage(t, ENGLISH).alias("a"))
    join = lambda c: F.array_join(F.col(f"a.{c}"), ",")
    return a.select("id", "a.polarity", join("flags").alias("flags"),
                    join("procurement_ids").alias("ids"), join("parcels").alias("parcels"))


CAP_SQL = """case when flag <> '' and relationship in ('direct_implementation', 'supporting', 'budget') then 'related_but_indirect' else relationship end"""
REPAIR_REASON = rl.FLAG_REASONS["maintenance_only_suspect"]
CHANGE_REASON = rl.FLAG_REASONS["regression_warning"]


@query("E17_cap_hint", cte("links") + f""", f as (select *, case when id % 2 = 0 then 'x' else '' end as flag from links)
select id, {CAP_SQL} as relationship, 'text' || case when flag <> '' then '; {REPAIR_REASON}' else '' end as reasons from f""")
def e17(spark, sf):
    flags = F.when(F.col("id") % 2 == 0, F.array(F.lit("maintenance_only_suspect"), F.lit("other"))
                   ).otherwise(F.array(F.lit("other")))
    c = rl.cap_hint(F.col("relationship"), F.array(F.lit("text")), flags)
    return view(spark, sf, "links").select("id", c.alias("c")).select(
        "id", "c.relationship", F.array_join("c.reasons", "; ").alias("reasons"))


@query("E18_audited_hint", cte("links", "evidence") + f""", f as (select l.*, e.polarity, case when e.polarity <> 'affirmative' then 'x' else '' end as flag from links l join evidence e on e.id = l.evidence_id)
select id, {CAP_SQL} as relationship, 'text' || case when flag <> '' then '; the passage reports a ' || polarity || ', not progress; {CHANGE_REASON}' else '' end as reasons from f""")
def e18(spark, sf):
    e = evidence(spark, sf).select(F.col("id").alias("evidence_id"), "snippet")
    rows = view(spark, sf, "links").join(e, "evidence_id")
    c = rl.audited_hint(F.col("relationship"), F.array(F.lit("text")),
                        F.array().cast("array<string>"), rl.polarity("snippet", ENGLISH))
    return rows.select("id", c.alias("c")).select("id", "c.relationship", F.array_join(
        "c.reasons", "; ").alias("reasons"))


@query("E19_merge_entities", r"""select item_id, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') as merged
from (select item_id, string_split_regex(text, '\s+') || string_split_regex(lower(text), '\s+') as ws from benchmark)""")
def e19(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(rl.merge_entities(
        tx.words("text"), tx.words(F.lower("text"))), " ").alias("merged"))


# -- matching --------------------------------------------------------------------------------

NAMES = """select p_partkey as id, array('Works', p_name, 'green') as a, array(concat(p_name, ' Ltd'), 'works', p_brand) as b, p_size, p_retailprice from {part}"""


@query("J8_shared_entities", "select p_partkey as id, case when 'works' < lower(p_name) then 'works, ' || lower(p_name) else lower(p_name) || ', works' end as shared from part")
def j8(spark, sf):
    s = mt.shared_names(mt.lowered("a"), mt.lowered("b"))
    return frame(spark, sf, NAMES).select("id", F.array_join(s, ", ").alias("shared"))


FEATURES_SQL = """with f as (select p_partkey as id, round(p_size / 50.0, 4) as sim, case when p_partkey % 3 = 0 then 1 else 0 end as o, case when p_partkey % 4 = 0 then 2 else 0 end as p, case when p_partkey % 5 = 0 then 1 else 0 end as d, p_partkey % 2 = 0 as money from part)"""


def feature_rows(spark, sf):
    p = table(spark, sf, "part")
    pick = lambda n, *names: F.when(F.col("p_partkey") % n == 0, F.array(
        *[F.lit(x) for x in names])).otherwise(F.array().cast("array<string>"))
    f = F.struct(F.round(F.col("p_size") / 50.0, 4).alias("similarity"),
                 pick(3, "acme").alias("shared_organisations"),
                 pick(4, "main st", "oak rd").alias("shared_locations"),
                 pick(5, "2030").alias("shared_dates"))
    return p.select(F.col("p_partkey").alias("id"), f.alias("f"),
                    (F.col("p_partkey") % 2 == 0).alias("money"))


@query("R12_match_score", FEATURES_SQL + " select id, round(least(1.0, round(0.6 * sim + 0.15 * least(o, 2) / 2 + 0.15 * least(p, 2) / 2 + 0.1 * least(d, 2) / 2, 4)), 4)::double as score from f")
def r12(spark, sf):
    return feature_rows(spark, sf).select("id", mt.match_score(F.col("f")).alias("score"))


@query("R13_suggest_relationship", FEATURES_SQL + """
select id, case when sim >= 0.58 and (o > 0 or p > 0) then 'direct_implementation' when money and sim >= 0.4 then 'budget' when sim >= 0.48 then 'supporting' when sim >= 0.4 then 'related_but_indirect' else 'probably_unrelated' end as relationship,
 case when sim >= 0.58 then 'the text is a close match' when sim >= 0.48 then 'the text is fairly similar' when sim >= 0.4 then 'some text overlap' else 'little text in common' end
 || case when o > 0 then '; names the same organisation: acme' else '' end || case when p > 0 then '; same place: main st, oak rd' else '' end || case when d > 0 then '; same year: 2030' else '' end
 || case when money then '; the page mentions a money figure' else '' end as reasons from f""")
def r13(spark, sf):
    s = mt.suggest_relationship(F.col("f"), F.col("money"))
    return feature_rows(spark, sf).select("id", s.alias("s")).select(
        "id", "s.relationship", F.array_join("s.reasons", "; ").alias("reasons"))


TITLE_SQL = r"""with k as (select doc_id, list_filter(list_distinct(string_split_regex(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+')), lambda x: length(x) > 1 and x not in ('a', 'an', 'and', 'download', 'downloads', 'for', 'in', 'of', 'on', 'pdf', 'the', 'to')) as ws from documents),
s as materialized (select list_sort(ws) as ws, min(doc_id) as id, count(*) as n, list_filter(list_sort(ws), lambda x: regexp_full_match(x, '\d+')) as d from k where len(ws) > 0 group by 1),
p as (select a.id as a, b.id as b from s a join s b on a.d = b.d and a.id <> b.id and 5 * least(len(a.ws), len(b.ws)) >= 4 * greatest(len(a.ws), len(b.ws))
 where len(list_intersect(a.ws, b.ws))::double / len(list_distinct(a.ws || b.ws)) >= 0.8),
r as (select a, count(*) as n, min(b) as b from p group by a)"""


def first_lines(spark, sf):
    """A title for every document: its whole first line."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.title_tokens(F.substring_index("text", "\n", 1), ENGLISH.title_stopwords).alias("ws"))


@query("J15_near_titles", TITLE_SQL + """
select k.doc_id, s.id as title_id, s.n as n_same, coalesce(r.n, 0) as n_near, least(s.id, coalesce(r.b, s.id)) as near_id
from k join s on list_sort(k.ws) = s.ws left join r on r.a = s.id""")
def j15(spark, sf):
    return mt.title_classes(first_lines(spark, sf), "doc_id", "ws")

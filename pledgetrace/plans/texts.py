"""Queries: text columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import fit_vector
from ..operators import pages as pg
from ..profile import ENGLISH
from ..session import spread
from .registry import query
from .views import cte, table, view

# white space as DuckDB's regular expressions have to spell it
SQL_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def frame(spark, sf, sql: str):
    """A small projection in Spark SQL over the tables and views it names in braces."""
    import re
    from .views import BASE
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spread(spark.sql(sql, **{n: (table if n in BASE else view)(spark, sf, n)
                                    for n in names}))


@query("P1_squash", rf"select doc_id, trim(regexp_replace(text, '{SQL_WS}+', ' ', 'g')) as text from documents")
def p1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.squash("text").alias("text"))


@query("P2_norm", r"select doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) as text from documents")
def p2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.norm("text").alias("text"))


EXCERPT = "replace(substring(text, 7, 60), ' ', '  ')"


@query("P3_receipt", cte("document_pages") + rf""",
p as (select *, {EXCERPT} as excerpt from document_pages),
b as (select *, regexp_replace(text, '{SQL_WS}', '', 'g') as bare, regexp_replace(excerpt, '{SQL_WS}', '', 'g') as want,
  list_filter(range(1, length(text) + 1), lambda i: not regexp_matches(text[i], '{SQL_WS}')) as places from p)
select document_id, page_number, case when want <> '' and position(want in bare) > 0 then
  substring(text, places[position(want in bare)], places[position(want in bare) + length(want) - 1] - places[position(want in bare)] + 1) end as receipt from b""")
def p3(spark, sf):
    p = view(spark, sf, "document_pages").withColumn("excerpt", F.expr(EXCERPT))
    return p.select("document_id", "page_number", tx.receipt("text", "excerpt").alias("receipt"))


@query("P4_verify_receipts", cte("document_pages") + """,
c as (select document_id, page_number + page_number % 2 as source_page, substring(text, 2, 30) as source_excerpt from document_pages)
select c.document_id, source_page, source_excerpt from c join document_pages p on c.document_id = p.document_id and c.source_page = p.page_number
where trim(source_excerpt) <> '' and contains(p.text, source_excerpt)""")
def p4(spark, sf):
    pages = view(spark, sf, "document_pages")
    cands = pages.select("document_id", (F.col("page_number") + F.col("page_number") % 2)
                         .alias("page_number"), F.substring("text", 2, 30).alias("excerpt"))
    kept = cands.join(pages, ["document_id", "page_number"]).filter(tx.on_page("text", "excerpt"))
    return kept.select("document_id", F.col("page_number").alias("source_page"),
                       F.col("excerpt").alias("source_excerpt"))


TITLES = """select o_orderkey as id, case o_orderkey % 4 when 0 then concat('M1.', o_orderkey, ' Works')
 when 1 then concat(o_orderkey, '.5 Plan for roads') when 2 then '2030 target' else concat(o_orderkey, '.1 million trees') end as title,
 case when o_orderkey % 3 = 0 then concat('Chapter 7. M 1.', o_orderkey, ' ', o_orderkey, '.5 Plan') else 'no code here' end as page from {orders}"""
TITLES_CTE = "with t as (" + TITLES.format(orders="orders") + ")"


@query("P5_lead_code", TITLES_CTE + " select id, case id % 4 when 0 then 'M1.' || id when 1 then id || '.5' end as code from t")
def p5(spark, sf):
    return frame(spark, sf, TITLES).select("id", tx.lead_code("title").alias("code"))


@query("P6_grounded_title", TITLES_CTE + """
select id, case when id % 4 > 1 or id % 3 = 0 then title when id % 4 = 0 then 'Works' else 'Plan for roads' end as title,
 case when id % 3 = 0 then case id % 4 when 0 then 'M1.' || id when 1 then id || '.5' end end as code from t""")
def p6(spark, sf):
    g = tx.grounded_title("title", F.lit("text"), "page")
    return frame(spark, sf, TITLES).select("id", g.alias("g")).select("id", "g.title", "g.code")


FORM_LABELS = ("budget", "time frame", "responsible", "responsible body")
QUOTES = """select l_orderkey as id, l_linenumber as n, case l_linenumber % 4 when 0 then concat('• Time   frame: ', l_orderkey)
 when 1 then concat('Code M', l_orderkey, ' responsible body Ab budget') when 2 then concat('The council will plant ', l_orderkey, ' trees within its budget by 2030')
 else concat('Budgeting for ', l_orderkey, ' new trees takes time') end as quote from {lineitem}"""


@query("P7_form_row", "with t as (" + QUOTES.format(lineitem="lineitem") + ") select id, n, quote, n % 4 < 2 as form_row from t")
def p7(spark, sf):
    return frame(spark, sf, QUOTES).select("id", "n", "quote",
                                           tx.form_row("quote", FORM_LABELS).alias("form_row"))


KIND_SQL = """select event_id as id, case event_type when 'click' then 'measure' when 'view' then 'objective' when 'error' then 'background' when 'purchase' then 'target' else 'unclear' end as kind from {events}"""


@query("P8_valid_kind", "with t as (" + KIND_SQL.format(events="events") + ") select id, kind from t where kind in ('objective', 'measure', 'target', 'indicator')")
def p8(spark, sf):
    return frame(spark, sf, KIND_SQL).filter(tx.valid_kind("kind"))


INTRO = "Find the commitments in these {language} pages.\n\n"


@query("P9_page_prompt", cte("document_pages") + """,
w as (select *, cast(floor((row_number() over (partition by document_id order by page_number) - 1) / 4) as int) as window from document_pages)
select document_id, "window", 'Find the commitments in these English pages.' || chr(10) || chr(10) || string_agg('--- page ' || page_number || ' ---' || chr(10) || left(text, 6000), chr(10) || chr(10) order by page_number) as prompt
from w group by all""")
def p9(spark, sf):
    return pg.page_prompt(view(spark, sf, "document_pages"), 4, INTRO, ENGLISH.name)


@query("P10_page_windows", cte("document_pages") + """
select document_id, page_number, cast(floor((row_number() over (partition by document_id order by page_number) - 1) / 3) as int) as "window" from document_pages""")
def p10(spark, sf):
    return pg.page_windows(view(spark, sf, "document_pages"), 3).select(
        "document_id", "page_number", "window")


@query("P11_halve", cte("source_pages") + r""",
l as (select page_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as ls from source_pages)
select page_id, cast(0 as int) as half, array_to_string(ls[1:len(ls) // 2], chr(10)) as text from l where len(ls) >= 2
union all select page_id, 1, array_to_string(ls[len(ls) // 2 + 1:], chr(10)) from l where len(ls) >= 2""")
def p11(spark, sf):
    return view(spark, sf, "source_pages").select(
        "page_id", F.posexplode(tx.halves("text")).alias("half", "text"))


@query("P12_display_title", "select c_custkey as id, c_name || ' ' || c_custkey || ' a.b' as title from customer")
def p12(spark, sf):
    return frame(spark, sf, """select c_custkey as id, concat('  **– ', c_name, '#` \t ', c_custkey, '> a.b:** - ') as t from {customer}""").select(
        "id", F.replace(tx.display_title("t"), F.lit("Customer0"), F.lit("Customer#0")).alias("title"))


@query("P13_title_tokens", cte("source_pages") + """
select page_id, array_to_string(list_sort(list_filter(list_distinct(string_split_regex(lower(title || ' of the-of  End'), '[^\\p{L}\\p{N}]+')), lambda x: length(x) > 1 and x not in ('of', 'the'))), ' ') as tokens from source_pages""")
def p13(spark, sf):
    t = F.concat("title", F.lit(" of the-of  End"))
    return view(spark, sf, "source_pages").select("page_id", F.array_join(F.array_sort(
        tx.title_tokens(t, ENGLISH.title_stopwords)), " ").alias("tokens"))


@query("P14_years", cte("evidence") + r""",
y as (select id, regexp_extract_all(snippet || ' See 2031, 1999 and 2031.', '\b(?:19|20)\d{2}\b') as ys from evidence)
select id, array_to_string(list_filter(ys, lambda x, i: list_position(ys, x) = i), ',') as years from y""")
def p14(spark, sf):
    return view(spark, sf, "evidence").select("id", F.array_join(tx.years(F.concat(
        "snippet", F.lit(" See 2031, 1999 and 2031."))), ",").alias("years"))


@query("P15_allowed", r"""with h as (select page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host from pages)
select page_id, url from h where host = 'example.org' or host like '%.example.org' or host = 'example.com' or host like '%.example.com'""")
def p15(spark, sf):
    domains = spark.createDataFrame([("example.org",), ("example.com",)], "domain string")
    return pg.allowed(table(spark, sf, "pages").select("page_id", "url"), domains)


@query("P16_canonical_url", "select page_id, string_split(url || '#top', '#')[1] as canonical, string_split(url, '?')[1] as bare from pages")
def p16(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.canonical_url(F.concat("url", F.lit("#top"))).alias("canonical"),
        tx.bare_url("url").alias("bare"))


@query("P17_search_key", cte("commitments_text") + r""",
w as (select id, code, summary, array_to_string(list_slice(list_filter(string_split_regex(summary, '\s+'), lambda x: x <> ''), 1, 10), ' ') as title from commitments_text)
select id, title || ' ' || code as search_key, title || ' ' || summary || ' ' || code as query_text from w""")
def p17(spark, sf):
    c = view(spark, sf, "commitments_text")
    title = F.array_join(F.slice(tx.words("summary"), 1, 10), " ")
    return c.select("id", tx.search_key("summary", "code").alias("search_key"),
                    tx.query_text(title, "summary", "code").alias("query_text"))


@query("P18_predates", "select o_orderkey as id, year(o_orderdate) < 1996 as predates from orders")
def p18(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                             tx.predates("o_orderdate", 1996).alias("predates"))


@query("P19_norm_place", """with p as (select p_partkey as id, lower('Old ' || p_name) as n from part)
select id, case when n like '%idget' then left(n, length(n) - 3) when n like '%g' and length(string_split(n, ' ')[-1]) >= 4 then left(n, length(n) - 1) else n end as place from p""")
def p19(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        tx.norm_place(F.concat(F.lit("Old "), F.col("p_name")), ("get", "g")).alias("place"))


@query("P20_fit_vector", """select vec_id, cast(128 as int) as dims, round(list_sum(embedding::double[]), 6) as total, embedding[3]::double as third, cast(0 as double) as last from embeddings""")
def p20(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", fit_vector("embedding", 128).alias("v"))
    return v.select("vec_id", F.size("v").alias("dims"), F.round(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"),
        F.element_at("v", 3).cast("double").alias("third"),
        F.element_at("v", 128).cast("double").alias("last"))


@query("P21_content_key", "select doc_id, left(sha256('structure-v2|hashing|2400|' || text), 24) as content_key, left(sha256(text), 16) as text_key from documents")
def p21(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.content_key(F.lit("hashing"), 2400, "text").alias("content_key"),
        tx.text_key("text").alias("text_key"))


@query("P22_truncate_guard", cte("source_pages") + """
select page_id, left(text, 3000) as text, case when length(text) > 3000 then title || ' is larger than the safety limit (3,000 chars), only the first part was searched.' end as warning from source_pages""")
def p22(spark, sf):
    return pg.clipped(view(spark, sf, "source_pages"), "page_id", "title", 3000)


@query("P24_display_columns", cte("commitments", "evidence") + """
select c.id, case when target_value is null then '2030' when target_value = round(target_value, 0) or target_value < 1000 then 'x' else round(target_value, case when target_value >= 100000 then 0 when target_value >= 10000 then 1 else 2 end)::varchar || ' by 2030' end as goal, c.title,
 replace(format('{:,}', cast(round_even(coalesce(target_value, 0), 0) as bigint)), ',', ' ') || ' Ft' as huf,
 'Strategy · page 7' as label, 'https://x.example.org/a.pdf#page=7' as href, case when c.id % 2 = 0 then 'Strategy / report' else 'Project / update' end as kind from commitments c""")
def p24(spark, sf):
    c = view(spark, sf, "commitments")
    g = tx.goal("target_value", F.lit(None), F.lit(2030), F.lit(None))
    link = tx.page_link(F.lit("https://x.example.org/a.pdf#top"), F.lit(7))
    title = F.when(F.col("id") % 2 == 0, F.lit("Annual Report")).otherwise(F.lit("New trees"))
    return c.select(
        "id", F.when(F.col("target_value").isNull(), g).when(
            (F.col("target_value") == F.round("target_value", 0)) | (F.col("target_value") < 1000),
            F.lit("x")).otherwise(g).alias("goal"), "title",
        tx.huf(F.coalesce("target_value", F.lit(0))).alias("huf"), link["label"].alias("label"),
        link["href"].alias("href"), tx.evidence_kind(F.lit("u"), title).alias("kind"))


@query("P25_code_hint", cte("commitments") + """
select id, case when code is not null then 'Mitigation' end as meaning, case when code is not null then cast(2 as int) end as depth from commitments""")
def p25(spark, sf):
    h = tx.code_hint("code", {"M": "Mitigation", "A": "Adaptation"})
    return view(spark, sf, "commitments").select("id", h["meaning"].alias("meaning"),
                                                 h["depth"].alias("depth"))


@query("P27_note_item", cte("commitments", "evidence") + """
select e.id, 'commitment: ' || coalesce(c.code, '') || ' ' || c.title || chr(10) || 'evidence from ' || e.url || ' (' || e.published_year || '):' || chr(10) || e.title || chr(10) || left(e.snippet, 1500) as item
from evidence e join commitments c on c.id = e.commitment_id""")
def p27(spark, sf):
    e = view(spark, sf, "evidence").withColumn("published_on", F.col("published_year"))
    c = view(spark, sf, "commitments").select(F.col("id").alias("commitment_id"), "code",
                                              F.col("title").alias("commitment_title"))
    return e.join(c, "commitment_id").select("id", tx.link_note(
        "code", "commitment_title", "url", "published_on", "title", "snippet").alias("item"))


@query("P28_word_pack", r"""with recursive s as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as r from documents),
w as (select doc_id, 0 as i, cast('' as varchar) as piece, r as rest from s where r <> ''
 union all select doc_id, i + 1, left(rest, cut), ltrim(substring(rest, cut + 1)) from (
  select *, case when length(rest) <= 1000 then length(rest) when position(' ' in rest) between 1 and 1001 then 1001 - position(' ' in reverse(left(rest, 1001))) when position(' ' in rest) > 0 then position(' ' in rest) - 1 else length(rest) end as cut from w where rest <> ''))
select doc_id, cast(i - 1 as int) as pos, piece from w where i > 0""")
def p28(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(tx.word_pack("text")).alias("pos", "piece"))


@query("P29_dedupe_names", r"""with w as (select item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as ns from benchmark),
l as (select *, list_transform(ns, lambda x: lower(x)) as ls from w)
select item_id, array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(ls[i + 1:], ls[i])), lambda i: ns[list_position(ls, ls[i])]), ' ') as names from l""")
def p29(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(
        tx.dedupe_names(tx.words("text")), " ").alias("names"))


TITLE_SQL = "select page_id as id, url, case page_id % 3 when 0 then url when 1 then concat('Report-', page_id, '.PDF') else 'A real title' end as title from {pages}"


@query("P30_better_title", "with t as (" + TITLE_SQL.format(pages="pages") + ") select id, id % 3 < 2 as needs_title from t")
def p30(spark, sf):
    return frame(spark, sf, TITLE_SQL).select("id", tx.filename_like("url", "title").alias("needs_title"))


@query("S7_page_markdown", cte("document_pages") + """
select document_id, page_number, '<!-- page ' || page_number || ' -->' || chr(10) || text as text from document_pages""")
def s7(spark, sf):
    return pg.page_markdown(view(spark, sf, "document_pages"))

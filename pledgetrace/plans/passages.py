"""Queries: chunking, embedding, retrieval, ranking of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine
from ..operators import evidence as ev
from ..operators import retrieval as rt
from ..operators import sourcing as so
from ..operators.chunking import chunk, quarantined_rows
from ..operators.index import passages_of_pages
from ..profile import ENGLISH
from .registry import query
from .views import cte, table, view

KEYS = ["page_id", "chunk_index"]
K = 5

# passages in plain SQL: sections, then windows whose borders respect table rows
CHUNK_SQL = cte("source_pages") + r""",
secs as (select page_id, unnest(string_split(regexp_replace(text, '(?m)^(#{1,6} |<!-- page )', chr(1) || '\1', 'g'), chr(1))) as s,
  generate_subscripts(string_split(regexp_replace(text, '(?m)^(#{1,6} |<!-- page )', chr(1) || '\1', 'g'), chr(1)), 1) as sec from source_pages),
raw_lines as (select page_id, sec, unnest(string_split(s, chr(10))) as l, generate_subscripts(string_split(s, chr(10)), 1) as i, len(string_split(s, chr(10))) as n from secs),
lines as (select page_id, sec, i, l || case when i < n then chr(10) else '' end as l, contains(l, '|') and length(l) > 2400 as bad from raw_lines),
grouped as (select *, sum(case when bad then 1 else 0 end) over (partition by page_id, sec order by i) as part from lines),
offs as (select page_id, sec, part, i, l, cast(sum(length(l)) over (partition by page_id, sec, part order by i) - length(l) as bigint) as a from grouped where not bad),
parts as (select page_id, sec, part, string_agg(l, '' order by i) as s,
  list({'l': a, 'r': a + length(l)} order by i) filter (contains(l, '|')) as spans from offs group by page_id, sec, part),
w as (
  select page_id, sec, part, s, spans, cast(0 as bigint) as st, case when ln is null or ln.l <= 0 then e0 else ln.l end as en
  from (select *, list_filter(spans, lambda x: x.l < e0 and e0 < x.r)[1] as ln from (select *, least(2400, length(s)) as e0 from parts where length(s) > 0))
  union all
  select page_id, sec, part, s, spans, st2, case when ln is null or ln.l <= st2 then e0 else ln.l end as en
  from (select *, list_filter(spans, lambda x: x.l < e0 and e0 < x.r)[1] as ln from (select *, least(st2 + 2400, length(s)) as e0 from (
    select *, least(case when ln2 is null then f when ln2.l > st then ln2.l else ln2.r end, en) as st2
    from (select *, list_filter(spans, lambda x: x.l < f and f < x.r)[1] as ln2 from (select *, greatest(st + 1, en - 400) as f from w where en < length(s))))))
),
chunks as materialized (select page_id, row_number() over (partition by page_id order by sec, part, st) - 1 as chunk_index, substring(s, st + 1, en - st) as chunk
  from w where regexp_matches(substring(s, st + 1, en - st), '\S'))"""

QUERY_SQL = CHUNK_SQL + """,
cmt as (select item_id as id, text as summary, 'M' || (1 + item_id % 3) || '.' || item_id as code from benchmark),
q as (select id as query_id, array_to_string(list_slice(list_filter(string_split_regex(summary, '\\s+'), lambda x: x <> ''), 1, 10), ' ') || ' ' || summary || ' ' || code as text from cmt),
ctok as materialized (select page_id, chunk_index, unnest(list_filter(string_split_regex(lower(chunk), '\\s+'), lambda x: x <> '')) as t from chunks),
qtok as (select query_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as t from q),
toks as materialized (select t, ((((('0x' || substr(md5(t), 1, 8))::bigint % 384) * 256 + ('0x' || substr(md5(t), 9, 8))::bigint) % 384 * 256 + ('0x' || substr(md5(t), 17, 8))::bigint) % 384 * 256 + ('0x' || substr(md5(t), 25, 8))::bigint) % 384 as dim
  from (select t from ctok union select t from qtok)),
cvec as materialized (select page_id, chunk_index, dim, count(*)::double as x from ctok join toks using (t) group by all),
qvec as materialized (select query_id, dim, count(*)::double as x from qtok join toks using (t) group by all),
cnorm as (select page_id, chunk_index, sqrt(sum(x * x)) as n from cvec group by all),
qnorm as (select query_id, sqrt(sum(x * x)) as n from qvec group by all),
dots as materialized (select query_id, page_id, chunk_index, sum(a.x * b.x) as d from cvec a join qvec b using (dim) group by all),
sims as materialized (select q.query_id, c.page_id, c.chunk_index, round(coalesce(d, 0) / (c.n * q.n), 9) as similarity
  from qnorm q cross join cnorm c left join dots using (query_id, page_id, chunk_index)),
cterm as materialized (select page_id, chunk_index, t, count(*) as tf from (select page_id, chunk_index, unnest(string_split_regex(lower(chunk), '[^\\p{L}\\p{N}_]+')) as t from chunks) where t <> '' group by all),
qterm as materialized (select distinct query_id, t from (select query_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) as t from q) where t <> ''),
lex as materialized (select query_id, page_id, chunk_index, sum(tf)::bigint as hits, count(*) as n_terms from cterm join qterm using (t) group by all)"""


# the pages a commitment may see: those of its owner's registry and the general ones. The registry
# has a source for each page, every fourth of them general; an owner is one of three kinds
OWNERS = "case {0} % {1} when 0 then {2} when 1 then 'public_utility_water' when 2 then 'national_government' else 'district_municipality' end"
SOURCE_OWNER, COMMITMENT_OWNER = OWNERS.format("page_id", 4, "null"), OWNERS.format("id", 3, "'district_municipality'")
SEEN_SQL = f""",
owned as (select page_id, {SOURCE_OWNER} as owner from source_pages), asking as (select id as query_id, {COMMITMENT_OWNER} as owner from cmt),
seen as materialized (select query_id, page_id from owned o join asking a on o.owner is null or o.owner = a.owner)"""


def hybrid_sql(k: int, restricted: bool = False) -> str:
    pool = rt.pool_size(k)
    return QUERY_SQL + (SEEN_SQL if restricted else "") + f""",
al as materialized (select s.*, coalesce(l.hits, 0) as hits from sims s left join lex l using (query_id, page_id, chunk_index) {"semi join seen using (query_id, page_id)" if restricted else ""}),
dr as (select *, row_number() over (partition by query_id order by similarity desc, page_id, chunk_index) as r from al qualify r <= {pool}),
lr as (select *, row_number() over (partition by query_id order by hits desc, page_id, chunk_index) as r from al where hits > 0 qualify r <= {pool}),
fused as (select query_id, page_id, chunk_index, sum(1.0 / (60 + r)) as fused, max(similarity) as similarity from (select * from dr union all select * from lr) group by all),
hyb as materialized (select *, row_number() over (partition by query_id order by fused desc, page_id, chunk_index) as rank from fused qualify rank <= {k})"""


def eligible(spark, sf):
    """What each commitment may see, by way of the registry, as evidence search does it."""
    pages = view(spark, sf, "source_pages")
    com = commitment_queries(spark, sf).select(
        F.col("query_id").alias("id"), "title", "code", F.expr(COMMITMENT_OWNER.replace("id", "query_id", 1)).alias("jurisdiction"))
    registry = pages.select(
        F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("publisher"), "title",
        F.col("page_id").cast("int").alias("sort_order"), F.expr(SOURCE_OWNER).alias("jurisdiction"))
    none = spark.createDataFrame([], "pos int, query_substring string, url string")
    return so.eligible_pages(com, registry, none, pages, [])


def commitment_queries(spark, sf):
    """Commitments with the text they are searched by; the title is the first ten words."""
    c = view(spark, sf, "commitments_text")
    c = c.withColumn("title", F.array_join(F.slice(tx.words("summary"), 1, 10), " "))
    return c.select("id", "title", "summary", "code", "deadline_year",
                    tx.query_text("title", "summary", "code").alias("chunk")).withColumnRenamed(
        "id", "query_id")


def passages(spark, sf):
    return chunk(view(spark, sf, "source_pages"))


@query("C1_chunk", CHUNK_SQL + " select page_id, cast(chunk_index as int) as chunk_index, chunk from chunks")
def c1(spark, sf):
    return passages(spark, sf).select("page_id", "chunk_index", "chunk")


@query("J1_chunks_of_pages", CHUNK_SQL + """
select c.page_id, cast(c.chunk_index as int) as chunk_index, d.url, d.title, c.chunk from chunks c join source_pages d using (page_id) where d.published_year >= 2018 and d.page_id % 3 <> 0""")
def j1(spark, sf):
    pages = view(spark, sf, "source_pages")
    key = tx.content_key(F.lit("hashing"), 2400, "text")
    # every third text has changed since its passages were stored
    old = F.when(F.col("page_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    made = pages.select("page_id", tx.content_key(F.lit("hashing"), 2400, old).alias("embed_model"))
    stored = passages(spark, sf).join(made, "page_id")
    return passages_of_pages(stored, pages, pages.filter("published_year >= 2018"), key).select(
        "page_id", "chunk_index", "url", "title", "chunk")


@query("C2_quarantine_rows", cte("source_pages") + """,
lines as (select page_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from source_pages)
select page_id, cast(line_no as int) as line_no, cast(length(l) as int) as row_chars, 'Markdown table row exceeds passage limit; quarantined from automated extraction' as warning
from lines where contains(l, '|') and length(l) > 60""")
def c2(spark, sf):
    return quarantined_rows(view(spark, sf, "source_pages"), "page_id", limit=60)


@query("R1_hashing_embed", """with t as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as t from documents)
select doc_id, cast(((((('0x' || substr(md5(t), 1, 8))::bigint % 384) * 256 + ('0x' || substr(md5(t), 9, 8))::bigint) % 384 * 256 + ('0x' || substr(md5(t), 17, 8))::bigint) % 384 * 256 + ('0x' || substr(md5(t), 25, 8))::bigint) % 384 as int) as dim, count(*)::double as weight from t group by all""")
def r1(spark, sf):
    return rt.hashing_embed(table(spark, sf, "documents"), "doc_id", "text")


CENTROID_SQL = """with d as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
m as (select label, i, sum(x) / count(*) as x from d group by all),
c as (select label, list(x order by i) as c from m group by label)"""


def centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg((F.sum(F.col("x").cast("double")) / F.count("*")).alias("x"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))),
                                              lambda s: s["x"]).alias("vector"))


@query("R2_cosine", CENTROID_SQL + """
select vec_id, round(list_cosine_similarity(embedding::double[], c), 6) as similarity from embeddings join c using (label)""")
def r2(spark, sf):
    e = table(spark, sf, "embeddings").join(centroids(spark, sf), "label")
    return e.select("vec_id", F.round(cosine("embedding", "vector"), 6).alias("similarity"))


@query("R3_match_dense", CENTROID_SQL + """,
s as (select c.label as query_id, vec_id, round(list_cosine_similarity(embedding::double[], c.c), 9) as s from embeddings e join c on (vec_id + c.label) % 3 <> 0)
select query_id, vec_id, round(s, 6) as similarity, cast(row_number() over (partition by query_id order by s desc, vec_id) as int) as rank from s qualify rank <= 20""")
def r3(spark, sf):
    q = centroids(spark, sf).withColumnRenamed("label", "query_id")
    e = table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector")
    # a query sees the vectors whose number and its own are no multiple of three together
    third = lambda c: F.explode(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda g: (c + g) % 3 != 0)).alias("group")
    seen = rt.Eligible(q.select("query_id", third(F.col("query_id"))), e.select((F.col("vec_id") % 3).alias("group"), "vec_id"))
    return rt.match_dense(q, e, ["vec_id"], 20, eligible=seen, page="vec_id").select(
        "query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("T1_dense_pool", QUERY_SQL + """
select query_id, page_id, cast(chunk_index as int) as chunk_index, round(similarity, 6) as similarity, cast(row_number() over (partition by query_id order by similarity desc, page_id, chunk_index) as int) as rank
from sims qualify rank <= 20""")
def t1(spark, sf):
    return rt.match_dense(commitment_queries(spark, sf), passages(spark, sf), KEYS,
                          rt.pool_size(K), vector=None, text="chunk").select(
        "query_id", *KEYS, F.round("similarity", 6).alias("similarity"), "rank")


@query("R4_lexical_or", QUERY_SQL + """
select query_id, page_id, cast(chunk_index as int) as chunk_index, hits, cast(row_number() over (partition by query_id order by hits desc, page_id, chunk_index) as int) as rank
from lex qualify rank <= 20""")
def r4(spark, sf):
    return rt.match_lexical(commitment_queries(spark, sf), passages(spark, sf), KEYS,
                            rt.pool_size(K), text="chunk")


@query("R5_lexical_and", QUERY_SQL + """,
qs as (select distinct query_id, t from (select id as query_id, unnest(string_split_regex(lower(summary), '[^\\p{L}\\p{N}_]+')) as t from cmt) where t <> ''),
need as (select query_id, count(*) as n from qs group by all),
l2 as (select query_id, page_id, chunk_index, sum(tf)::bigint as hits, count(*) as n_terms from cterm join qs using (t) group by all)
select query_id, page_id, cast(chunk_index as int) as chunk_index, hits, cast(row_number() over (partition by query_id order by hits desc, page_id, chunk_index) as int) as rank
from l2 join need using (query_id) where n_terms = n qualify rank <= 20""")
def r5(spark, sf):
    q = commitment_queries(spark, sf).withColumn("chunk", F.col("summary"))
    return rt.match_lexical(q, passages(spark, sf), KEYS, rt.pool_size(K), text="chunk",
                            need_all=True)


@query("R6_fuse_minmax", QUERY_SQL + """,
al as (select query_id, page_id, chunk_index, similarity as d, coalesce(hits, 0) as l from sims left join lex using (query_id, page_id, chunk_index)),
b as (select query_id, min(d) as d0, max(d) as d1, min(l) as l0, max(l) as l1 from al group by all),
f as (select query_id, page_id, chunk_index, round(0.5 * (l - l0) / greatest(l1 - l0, 1e-9) + 0.5 * (d - d0) / greatest(d1 - d0, 1e-9), 9) as fused from al join b using (query_id))
select query_id, page_id, cast(chunk_index as int) as chunk_index, round(fused, 6) as fused, cast(row_number() over (partition by query_id order by fused desc, page_id, chunk_index) as int) as rank
from f qualify rank <= 5""")
def r6(spark, sf):
    return rt.fuse_minmax(commitment_queries(spark, sf), passages(spark, sf), KEYS, K,
                          text="chunk").select("query_id", *KEYS,
                                               F.round("fused", 6).alias("fused"), "rank")


@query("R8_match_hybrid", hybrid_sql(K, restricted=True) + """
select query_id, page_id, cast(chunk_index as int) as chunk_index, round(fused, 6) as fused, round(similarity, 6) as similarity, cast(rank as int) as rank
from hyb""")
def r8(spark, sf):
    hits = rt.match_hybrid(commitment_queries(spark, sf), passages(spark, sf), KEYS, K,
                           text="chunk", eligible=eligible(spark, sf))
    return hits.select("query_id", *KEYS, F.round("fused", 6).alias("fused"),
                       F.round("similarity", 6).alias("similarity"), "rank")


def ranked_sql(k: int, restricted: bool = False) -> str:
    """Best passage per page, then the first of equal texts, in rank order."""
    return hybrid_sql(k, restricted) + """,
pg as (select page_id, left(sha256(text), 16) as text_key, url, published_year from source_pages),
b1 as (select *, row_number() over (partition by query_id, page_id order by rank) as r1 from hyb join pg using (page_id) qualify r1 = 1),
b2 as (select *, row_number() over (partition by query_id, text_key order by rank) as r2 from b1 qualify r2 = 1),
docs as (select query_id, page_id, chunk_index, similarity, url, published_year, row_number() over (partition by query_id order by rank) as doc_rank from b2)"""


@query("R10_rank_documents", ranked_sql(20, restricted=True) + """
select query_id, page_id, cast(chunk_index as int) as chunk_index, cast(doc_rank as int) as doc_rank, chunk from docs join chunks using (page_id, chunk_index) where doc_rank <= 5""")
def r10(spark, sf):
    best = ev.rank_documents(commitment_queries(spark, sf), view(spark, sf, "source_pages"),
                             ENGLISH, eligible=eligible(spark, sf))
    return best.filter(F.col("doc_rank") <= 5).select(
        "query_id", "page_id", "chunk_index", F.col("doc_rank").cast("int").alias("doc_rank"),
        "chunk")


@query("R14_find_evidence", ranked_sql(20, restricted=True) + """,
l as (select query_id as commitment_id, url, published_year, round(similarity, 4) as sim from docs where doc_rank <= 5)
select commitment_id, url, sim as similarity, round(0.6 * sim, 4) as score,
 case when sim >= 0.48 then 'supporting' when sim >= 0.4 then 'related_but_indirect' else 'probably_unrelated' end as suggested_relationship,
 case when sim >= 0.58 then 'the text is a close match' when sim >= 0.48 then 'the text is fairly similar' when sim >= 0.4 then 'some text overlap' else 'little text in common' end
 || case when published_year < 2020 then '; published ' || published_year || ' — predates the strategy, so it can only be context' else '' end as reasons,
 case when published_year < 2020 then 'background_only' else 'unknown' end as status_hint, 'affirmative' as polarity from l""")
def r14(spark, sf):
    out = ev.find_evidence(commitment_queries(spark, sf), view(spark, sf, "source_pages"),
                           ENGLISH, baseline_year=2020, eligible=eligible(spark, sf))
    e = out["evidence"].select(F.col("id").alias("evidence_id"), "status_hint", "polarity")
    return out["links"].join(e, "evidence_id").select(
        "commitment_id", "url", F.col("features.similarity").alias("similarity"), "score",
        "suggested_relationship", F.array_join("reasons", "; ").alias("reasons"), "status_hint",
        "polarity")


@query("R11_missing_vectors", "select doc_id as page_id from documents where doc_id % 3 = 0")
def r11(spark, sf):
    pages = view(spark, sf, "source_pages")
    key = tx.content_key(F.lit("hashing"), 2400, "text")
    # stored vectors: every third text has changed since
    old = F.when(F.col("page_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    stored = pages.select("page_id", tx.content_key(F.lit("hashing"), 2400, old)
                          .alias("embed_model"))
    return rt.missing_vectors(pages, stored, key).select("page_id")


@query("T2_lexical_pool", QUERY_SQL + """
select query_id, page_id, cast(chunk_index as int) as chunk_index, hits from lex qualify row_number() over (partition by query_id order by hits desc, page_id, chunk_index) <= 40""")
def t2(spark, sf):
    return rt.match_lexical(commitment_queries(spark, sf), passages(spark, sf), KEYS,
                            rt.pool_size(10), text="chunk").drop("rank")


@query("T3_fused_top", hybrid_sql(10) + """
select query_id, page_id, cast(chunk_index as int) as chunk_index, cast(rank as int) as rank from hyb""")
def t3(spark, sf):
    return rt.match_hybrid(commitment_queries(spark, sf), passages(spark, sf), KEYS, 10,
                           text="chunk").select("query_id", *KEYS, "rank")


@query("W2_best_chunk", hybrid_sql(20) + """
select query_id, page_id, cast(chunk_index as int) as chunk_index from hyb qualify row_number() over (partition by query_id, page_id order by rank) = 1""")
def w2(spark, sf):
    hits = rt.match_hybrid(commitment_queries(spark, sf), passages(spark, sf), KEYS, 20,
                           text="chunk")
    return hits.groupBy("query_id", "page_id").agg(F.min_by("chunk_index", "rank")
                                                   .alias("chunk_index"))


@query("W3_drop_copies", ranked_sql(20) + " select query_id, page_id, cast(doc_rank as int) as doc_rank from docs")
def w3(spark, sf):
    best = ev.rank_documents(commitment_queries(spark, sf), view(spark, sf, "source_pages"),
                             ENGLISH)
    return best.select("query_id", "page_id", F.col("doc_rank").cast("int").alias("doc_rank"))


@query("W10_chunk_index", CHUNK_SQL + " select page_id, count(*) as n, cast(max(chunk_index) as int) as last from chunks group by all")
def w10(spark, sf):
    return passages(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"),
                                                      F.max("chunk_index").alias("last"))


@query("J19_scored_bounds", QUERY_SQL + """,
b as (select query_id, min(similarity) as d0, max(similarity) as d1 from sims group by all)
select query_id, page_id, cast(chunk_index as int) as chunk_index, round((similarity - d0) / greatest(d1 - d0, 1e-9), 6) as scaled from sims join b using (query_id)
qualify row_number() over (partition by query_id order by similarity desc, page_id, chunk_index) <= 20""")
def j19(spark, sf):
    return rt.fuse_minmax(commitment_queries(spark, sf), passages(spark, sf), KEYS, 20,
                          text="chunk", weight=0.0).select(
        "query_id", *KEYS, F.round("fused", 6).alias("scaled"))

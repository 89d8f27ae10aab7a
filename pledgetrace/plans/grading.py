"""Queries: evaluation, set operations, window rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import retrieval as rt
from .registry import query
from .texts import frame
from .views import cte, table, view

# two systems rank all graded documents of a source, by length and by age
RANKED = cte("grades_a", "grades_b") + """, sc as (select 'length' as system, source as query, doc_id as doc, cast(n_chars as double) as score from documents union all select 'hybrid', source, doc_id, cast(doc_id as double) from documents),
rk as (select *, row_number() over (partition by system, query order by score desc, doc) as rank from sc)"""
DEPTH = 20


def scores(spark, sf):
    d = table(spark, sf, "documents")
    one = lambda name, c: d.select(F.lit(name).alias("system"), F.col("source").alias("query"),
                                   F.col("doc_id").alias("doc"), c.cast("double").alias("score"))
    return one("length", F.col("n_chars")).unionByName(one("hybrid", F.col("doc_id")))


def ranked(spark, sf, depth: int = DEPTH):
    return rt.top_per(scores(spark, sf), ["system", "query"], [F.desc("score"), F.col("doc")],
                      depth)


def qrels(spark, sf):
    return view(spark, sf, "grades_a")


def grades(spark, sf):
    a, b = view(spark, sf, "grades_a"), view(spark, sf, "grades_b")
    judge = a.withColumn("grade", F.lit(3) - F.col("grade"))
    return (a.withColumn("grader", F.lit("anna")).unionByName(b.withColumn("grader", F.lit("bela")))
            .unionByName(judge.withColumn("grader", F.lit("judge"))))


GRADES = cte("grades_a", "grades_b") + """, gr as (select 'anna' as grader, * from grades_a union all select 'bela', * from grades_b union all select 'judge', query, doc, cast(3 - grade as int) from grades_a)"""


@query("L1_load_qrels", cte("grades_a", "grades_b") + """, r as (select query, doc, 1 as grade, -1 as s from grades_a union all select query, doc, grade, 0 from grades_a where grade <> 1 union all select query, doc, grade, 1 from grades_b where grade > 1)
select query, doc, cast(grade as int) as grade from r qualify row_number() over (partition by query, doc order by s desc) = 1""")
def l1(spark, sf):
    line = lambda df, n: df.withColumn("source_rank", F.lit(n)).withColumn("line", F.col("doc"))
    a, b = view(spark, sf, "grades_a"), view(spark, sf, "grades_b")
    return ev.load_qrels(a.select("query", "doc"), line(a.filter("grade <> 1"), 0).unionByName(
        line(b.filter("grade > 1"), 1)))


METRICS = RANKED + """, ks as (select unnest([5, 20]) as k),
sh as (select system, query, doc, rank, k, grade from rk join ks on rank <= k left join grades_a using (query, doc)),
idl as (select query, k, sum((pow(2, grade) - 1) / log2(r + 1)) as idcg from (select query, grade, row_number() over (partition by query order by grade desc, doc) as r from grades_a where grade > 0) join ks on r <= k group by all),
nr as (select query, count(*) filter (grade >= 1) as n from grades_a group by all),
mt as (select system, query, k, count(*) as shown, count(*) filter (grade >= 1) as hit, min(rank) filter (grade >= 1) as first, count(grade) as judged, sum((pow(2, grade) - 1) / log2(rank + 1)) as dcg from sh group by all),
res as (select system, query, k, coalesce(hit / nullif(n, 0), 0) as recall, coalesce(1.0 / first, 0) as mrr, coalesce(coalesce(dcg, 0) / nullif(idcg, 0), 0) as ndcg, case when first = 1 then 1.0 else 0.0 end as p1, judged / shown as judged
 from mt left join nr using (query) left join idl using (query, k))"""


@query("L2_rank_metrics", METRICS + " select system, query, k, round(recall, 6) as recall, round(mrr::double, 6) as mrr, round(ndcg, 6) as ndcg, p1::double as p1, round(judged, 6) as judged from res")
def l2(spark, sf):
    m = ev.rank_metrics(ranked(spark, sf), qrels(spark, sf), [5, 20])
    r = lambda c: F.round(c, 6).alias(c)
    return m.select("system", "query", "k", r("recall"), r("mrr"), r("ndcg"), "p1", r("judged"))


AUROC = """select {g} (sum(rp) - cast(n1 as double) * (n1 + 1) / 2) / (cast(n1 as double) * n0) as auroc from (select *, rank() over (partition by {p} order by score) + (count(*) over (partition by {p}, score) - 1) / 2.0 as rp_all, case when pos then rank() over (partition by {p} order by score) + (count(*) over (partition by {p}, score) - 1) / 2.0 end as rp, count(*) filter (pos) over (partition by {p}) as n1, count(*) filter (not pos) over (partition by {p}) as n0 from x) group by {g} n1, n0"""


@query("L3_auroc", cte("grades_a") + ", x as (select lang, cast(n_chars as double) as score, grade >= 2 as pos from grades_a join documents on doc_id = doc) select lang, round(auroc, 6) as auroc from (" + AUROC.format(g="lang,", p="lang") + ")")
def l3(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "lang", F.col(
        "n_chars").cast("double").alias("score"))
    s = d.join(qrels(spark, sf), "doc").withColumn("positive", F.col("grade") >= 2)
    return ev.auroc(s, ["lang"]).withColumn("auroc", F.round("auroc", 6))


@query("L4_retrieval_report", METRICS + """, ans as (select distinct query from grades_a where grade >= 1), me as (select system, k, avg(recall) as recall, avg(mrr::double) as mrr, avg(ndcg) as ndcg, avg(p1::double) as p1, avg(judged) as judged from res where query in (select query from ans) group by all),
x as (select system, score, grade >= 1 as pos from rk join grades_a using (query, doc) where system <> 'hybrid'), au as (""" + AUROC.format(g="system,", p="system") + """)
select system, 'recall@' || k as metric, round(recall, 3) as value from me union all select system, 'mrr@' || k, round(mrr, 3) from me union all select system, 'ndcg@' || k, round(ndcg, 3) from me union all select system, 'judged@' || k, round(judged, 3) from me
union all select system, 'p@1', round(p1, 3) from me where k = 5 union all select system, 'auroc', round(auroc, 3) from au""")
def l4(spark, sf):
    s = scores(spark, sf)
    top = ranked(spark, sf)
    full = s.join(top.select("system", "query", "doc", "rank"), ["system", "query", "doc"], "left")
    return ev.retrieval_report(full, qrels(spark, sf), [5, 20])


@query("L5_pool", RANKED + " select distinct query, doc from rk where rank <= 20 and (query, doc) not in (select (query, doc) from grades_a)")
def l5(spark, sf):
    return ev.unjudged(ranked(spark, sf), qrels(spark, sf), DEPTH)


@query("J17_grader_pairs", GRADES + " select a.query, a.doc, a.grader as g1, b.grader as g2, a.grade as grade1, b.grade as grade2 from gr a join gr b using (query, doc) where a.grader < b.grader")
def j17(spark, sf):
    return ev.grader_pairs(grades(spark, sf))


KAPPA = """(with n as (select g1, g2, count(*) as n, count(*) filter (a = b) as same from {t} group by all), r as (select g1, g2, a as g, count(*) as x from {t} group by all), c as (select g1, g2, b as g, count(*) as y from {t} group by all),
 e as (select g1, g2, sum(x * y) as xy from r join c using (g1, g2, g) group by all)
 select g1, g2, n, same / n as obs, case when coalesce(xy, 0) <> n * n then (same / n - coalesce(xy, 0) / (n * n)) / (1 - coalesce(xy, 0) / (n * n)) end as kappa from n left join e using (g1, g2))"""
PAIRS = GRADES + ", pr as (select a.grader as g1, b.grader as g2, a.grade as a, b.grade as b from gr a join gr b using (query, doc) where a.grader < b.grader), pb as (select g1, g2, (a >= 2)::int as a, (b >= 2)::int as b from pr)"


@query("L6_kappa", PAIRS + " select g1, g2, cast(n as bigint) as n, round(obs, 6) as observed, round(kappa, 6) as kappa from " + KAPPA.format(t="pr"))
def l6(spark, sf):
    cells = ev.grader_pairs(grades(spark, sf)).groupBy(
        "g1", "g2", F.col("grade1").alias("a"), F.col("grade2").alias("b")).agg(
        F.count("*").alias("n"))
    return ev.kappa(cells, ["g1", "g2"]).select(
        "g1", "g2", "n", F.round("observed", 6).alias("observed"),
        F.round("kappa", 6).alias("kappa"))


@query("L7_agreement", PAIRS + " select f.g1, f.g2, cast(f.n as bigint) as pairs, round(f.obs, 3) as exact, round(h.obs, 3) as \"binary\", round(h.kappa, 3) as kappa_binary, round(f.kappa, 3) as kappa_4way from " + KAPPA.format(t="pr") + " f join " + KAPPA.format(t="pb") + " h using (g1, g2)")
def l7(spark, sf):
    return ev.agreement(grades(spark, sf))


@query("L8_consensus", GRADES + " select query, doc, cast(quantile_disc(grade, 0.5) as int) as grade, count(*) as graders from gr where grader <> 'judge' group by all")
def l8(spark, sf):
    return ev.consensus(grades(spark, sf))


@query("U2_graded_by_both", cte("grades_a", "grades_b") + " select query, doc, grade from grades_a intersect select query, doc, grade from grades_b")
def u2(spark, sf):
    return view(spark, sf, "grades_a").intersect(view(spark, sf, "grades_b"))


@query("U6_unjudged_pool", RANKED + " select distinct query, doc from rk where rank <= 10 and (query, doc) not in (select (query, doc) from grades_b where grade > 0)")
def u6(spark, sf):
    return ev.unjudged(ranked(spark, sf, 10), view(spark, sf, "grades_b").filter("grade > 0"), 10)


@query("W1_first_ranks", RANKED + ", dup as (select * from sc union all select system, query, doc, score - 0.5 from sc) select system, query, doc, cast(min(r) as int) as rank from (select *, row_number() over (partition by query, system order by score desc, doc) as r from dup) group by all")
def w1(spark, sf):
    s = scores(spark, sf)
    twice = s.unionByName(s.withColumn("score", F.col("score") - 0.5))
    return rt.first_ranks(twice, "query", "system", "doc", "score")


@query("R7_fuse_rrf", RANKED + " select query, doc, round(sum(1.0 / (60 + rank)), 9)::double as fused from rk where rank <= 20 group by all")
def r7(spark, sf):
    return rt.fuse_rrf(ranked(spark, sf), ["query", "doc"]).withColumn("fused", F.round("fused", 9))


@query("U1_dense_or_lexical", RANKED + " select query, doc from rk where system = 'length' and rank <= 20 union select query, doc from rk where system = 'hybrid' and rank <= 20")
def u1(spark, sf):
    r = ranked(spark, sf)
    one = lambda s: r.filter(F.col("system") == s).select("query", "doc")
    return one("length").unionByName(one("hybrid")).distinct()


@query("R9_rerank", RANKED + """, t as (select query, doc, rank, case when rank <= 5 then doc % 7 end as sc2 from rk where system = 'length' and rank <= 20)
select query, doc, cast(row_number() over (partition by query order by case when rank <= 5 then 0 else 1 end, sc2 desc nulls last, rank) as int) as reranked from t""")
def r9(spark, sf):
    r = ranked(spark, sf).filter(F.col("system") == "length").withColumn(
        "rerank_score", (F.col("doc") % 7).cast("double"))
    return rt.rerank(r, 5, ["query"]).select("query", "doc", "reranked")


@query("W6_score_bounds", RANKED + " select system, query, min(score) as low, max(score) as high from rk group by all")
def w6(spark, sf):
    return scores(spark, sf).groupBy("system", "query").agg(F.min("score").alias("low"),
                                                            F.max("score").alias("high"))


@query("W7_last_wins", "select user_id as link_id, event_type as decision from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def w7(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("link_id")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))


@query("W8_first_wins", "select l_orderkey as evidence_id, l_returnflag as kind, min_by(l_partkey, (l_linenumber, l_partkey)) as part from lineitem group by all")
def w8(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("evidence_id"), F.col("l_returnflag").alias("kind")).agg(
        F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("part"))


# gold keys: every page has one, its quote is on the page unless the turn is odd
GOLD = cte("document_pages") + """, g as (select 'd' || document_id as doc, 'p' || document_id as pdf, page_number as page, case when document_id % 3 = 0 then 'holdout' else 'train' end as split, page_number % 5 = 0 as empty,
 case when page_number % 5 = 0 then (case when document_id % 2 = 0 then '' else 'x' end) when page_number % 2 = 0 then replace(substring(text, 3, 40), ' ', '  ') else 'nowhere to be found' end as quote, text from document_pages),
k as (select *, case when empty then quote = '' else page % 2 = 0 end as kept from g)"""


def gold(spark, sf):
    p = view(spark, sf, "document_pages")
    n, d = F.col("page_number"), F.col("document_id")
    text = lambda pre: F.concat(F.lit(pre), d.cast("string"))
    quote = F.when(n % 5 == 0, F.when(d % 2 == 0, F.lit("")).otherwise(F.lit("x"))).when(
        n % 2 == 0, F.replace(F.substring("text", 3, 40), F.lit(" "), F.lit("  "))).otherwise(
        F.lit("nowhere to be found"))
    g = p.select(text("d").alias("doc"), text("p").alias("pdf"), n.alias("page"),
                 F.when(d % 3 == 0, "holdout").otherwise("train").alias("split"),
                 (n % 5 == 0).alias("empty"), quote.alias("quote"))
    pages = p.select(text("p").alias("pdf"), n.alias("page"), "text")
    return g, pages


@query("L9_check_gold", GOLD + " select doc, count(*) filter (kept) as kept, count(*) filter (not kept) as failed from k group by all")
def l9(spark, sf):
    return ev.gold_counts(ev.check_gold(*gold(spark, sf)))


@query("T6_spot_check", GOLD + """ select doc, page, empty, cast(r as int) as pick from (
 select *, row_number() over (partition by doc order by sha256(pdf || '|' || page), pdf, page) as r from k where kept) where r <= 2""")
def t6(spark, sf):
    return ev.spot_check(ev.check_gold(*gold(spark, sf)), 2, ["pdf", "page"]).select(
        "doc", "page", "empty", "pick")


DOCS = "select doc_id as doc, case when doc_id % 3 = 0 then 'holdout' else 'train' end as split, 1 + doc_id % 9 as gold, least(1 + doc_id % 9, quality * 4 + toxic) as found, round(quality / 2.0 + doc_id % 5 / 10.0, 3) as precision from {labels}"
PER_DOC = "with d as (" + DOCS.format(labels="labels") + "), p as (select *, round(found / gold, 3) as recall from d)"


def per_doc(spark, sf):
    d = frame(spark, sf, DOCS)
    return d.select("doc", "split", "gold", "found", F.round(F.col("found") / F.col("gold"), 3)
                    .alias("recall"), F.col("precision").cast("double"),
                    F.col("precision").cast("double").alias("f1"))


@query("L11_extraction_summary", PER_DOC + """ select count(*) as docs, sum(gold)::bigint as gold, round(sum(found) / sum(gold), 3) as recall_micro, round(avg(recall) filter (split = 'train'), 3) as recall_macro_train,
 round(avg(recall) filter (split = 'holdout'), 3) as recall_macro_holdout, round(avg(precision::double) filter (split = 'holdout'), 3) as precision_macro_holdout, round(avg(precision::double) filter (split = 'holdout'), 3) as f1_macro_holdout from p""")
def l11(spark, sf):
    return ev.extraction_summary(per_doc(spark, sf))


@query("L12_ship_gate", PER_DOC + """ select cast(0 as bigint) as differing, round(avg(recall), 3) as old_recall, round(avg(least(1.0, recall + 0.1)), 3)::double as new_recall, round(avg(least(1.0, recall + 0.1)), 3) > round(avg(recall), 3) as ship from p where split = 'holdout'""")
def l12(spark, sf):
    old = per_doc(spark, sf)
    return ev.ship_gate(old, old.withColumn("recall", F.least(F.lit(1.0), F.col("recall") + 0.1)))


@query("U4_holdout_difference", PER_DOC + " select doc from p where split = 'holdout' and doc % 4 = 0 union select doc from p where split <> 'holdout' and doc % 4 = 0")
def u4(spark, sf):
    old = per_doc(spark, sf)
    swap = F.when(F.col("doc") % 4 == 0, F.when(F.col("split") == "holdout", "train").otherwise(
        "holdout")).otherwise(F.col("split"))
    return ev.holdout_difference(old, old.withColumn("split", swap))

"""Grading retrieval, graders and extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import by_range, starts
from .retrieval import top_per


def load_qrels(inline: DataFrame, files: DataFrame) -> DataFrame:
    """inline(query, doc) counts as grade 1; files(query, doc, grade, source_rank, line)
    override it, the last line of the last file wins."""
    base = inline.select("query", "doc", F.lit(1).alias("grade"), F.lit(-1).alias("source_rank"),
                         F.lit(-1).cast("bigint").alias("line"))
    rows = base.unionByName(files.select("query", "doc", F.col("grade").cast("int"),
                                         F.col("source_rank").cast("int"),
                                         F.col("line").cast("bigint")))
    return rows.groupBy("query", "doc").agg(
        F.max_by("grade", F.struct("source_rank", "line")).alias("grade"))


def rank_metrics(ranked: DataFrame, qrels: DataFrame, ks: Sequence[int], min_grade: int = 1
                 ) -> DataFrame:
    """L2 per (system, query, k): recall, mrr, ndcg, p1, judged.

    ranked(system, query, doc, rank), ranks from 1. Only the first max(ks) rows of a ranking
    meet the grades. The ideal gain takes every grade above zero."""
    top = max(ks)
    each_k = F.explode(F.array(*[F.lit(k) for k in sorted(ks)])).alias("k")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    discount = F.log2(F.col("rank") + 1)
    best = top_per(qrels.filter("grade > 0"), ["query"], [F.desc("grade"), F.col("doc")], top)
    ideal = (best.select("query", "grade", "rank", each_k).filter("rank <= k")
             .groupBy("query", "k").agg(F.sum(gain / discount).alias("idcg")))
    need = qrels.groupBy("query").agg(
        F.count(F.when(F.col("grade") >= min_grade, 1)).alias("n_relevant"))
    hit = F.coalesce(F.col("grade") >= min_grade, F.lit(False))
    shown = (ranked.filter(F.col("rank") <= top).join(qrels, ["query", "doc"], "left")
             .select("system", "query", "rank", "grade", each_k).filter("rank <= k"))
    per = shown.groupBy("system", "query", "k").agg(
        F.count("*").alias("n_shown"), F.count(F.when(hit, 1)).alias("n_hit"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.count("grade").alias("n_judged"),
        F.sum(F.when(F.col("grade").isNotNull(), gain / discount)).alias("dcg"))
    j = per.join(need, "query", "left").join(ideal, ["query", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "system", "query", "k",
        zero(F.when(F.col("n_relevant") > 0, F.col("n_hit") / F.col("n_relevant")))
        .alias("recall"),
        zero(F.lit(1.0) / F.col("first_hit")).alias("mrr"),
        zero(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")))
        .alias("ndcg"),
        F.when(F.col("first_hit") == 1, 1.0).otherwise(0.0).alias("p1"),
        (F.col("n_judged") / F.col("n_shown")).alias("judged"))


def auroc(scores: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """L3: chance that a positive outscores a negative, ties half: (group…, auroc), null when
    a side is empty. scores(group…, score, positive).

    Rows are first counted per distinct score; the negatives below a score are those of the
    ranges before its own plus a running count inside its range, so no window spans a group."""
    group = list(group)
    pos, neg = F.col("positive"), ~F.col("positive")
    per = scores.groupBy(*group, "score").agg(F.count(F.when(pos, 1)).alias("p"),
                                              F.count(F.when(neg, 1)).alias("n"))
    parts = by_range(per, group, ["score"])
    inside = Window.partitionBy(*group, "_part").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1)
    lower = F.col("_below") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    wins = (parts.join(starts(parts, group, F.sum("n"), "_below"), [*group, "_part"])
            .withColumn("_w", F.col("p") * (lower + F.col("n") / 2.0))
            .groupBy(*group).agg(F.sum("_w").alias("_wins"), F.sum("p").alias("_p"),
                                 F.sum("n").alias("_n")))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return wins.select(*group, F.when(both, F.col("_wins") / (F.col("_p") * F.col("_n")))
                       .alias("auroc"))


def retrieval_report(ranked: DataFrame, qrels: DataFrame, ks: Sequence[int], min_grade: int = 1
                     ) -> DataFrame:
    """L4: (system, metric, value), means over the queries with something relevant, three
    decimals; p@1 once, auroc for systems whose scores mean something across queries."""
    answered = (qrels.filter(F.col("grade") >= min_grade).select("query").distinct())
    m = rank_metrics(ranked, qrels, ks, min_grade).join(answered, "query", "left_semi")
    means = m.groupBy("system", "k").agg(*[F.avg(c).alias(c) for c in
                                           ("recall", "mrr", "ndcg", "p1", "judged")])
    at = lambda n: F.struct(F.concat(F.lit(f"{n}@"), F.col("k").cast("string")).alias("metric"),
                            F.col(n).alias("value"))
    long = means.select("system", F.inline(F.array(*[at(n) for n in
                                                     ("recall", "mrr", "ndcg", "judged")])))
    p1 = means.filter(F.col("k") == min(ks)).select("system", F.lit("p@1").alias("metric"),
                                                    F.col("p1").alias("value"))
    judged = ranked.filter(F.col("system") != "hybrid").join(qrels, ["query", "doc"]).select(
        "system", "score", (F.col("grade") >= min_grade).alias("positive"))
    area = auroc(judged, ["system"]).select("system", F.lit("auroc").alias("metric"),
                                            F.col("auroc").alias("value"))
    return long.unionByName(p1).unionByName(area).withColumn("value", F.round("value", 3))


def unjudged(ranked: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """Pairs any system ranks in its first ``depth`` that nobody has graded."""
    return (ranked.filter(F.col("rank") <= depth).select("query", "doc").distinct()
            .join(qrels.select("query", "doc"), ["query", "doc"], "left_anti"))


def grader_pairs(grades: DataFrame) -> DataFrame:
    """What two graders gave the same pair. A grader grades a pair once, so a pair
    meets as many rows as there are graders, not as there are grades."""
    once = grades.groupBy("grader", "query", "doc").agg(F.max("grade").alias("grade"))
    side = lambda n: once.select("query", "doc", F.col("grader").alias(f"g{n}"),
                                 F.col("grade").alias(f"grade{n}"))
    return side(1).join(side(2), ["query", "doc"]).filter(F.col("g1") < F.col("g2"))


def kappa(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Chance-corrected agreement of counts(group…, a, b, n), null where chance explains
    everything: (group…, n, observed, kappa)."""
    group = list(group)
    total = counts.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))
                                     .otherwise(0)).alias("same"))
    rows = counts.groupBy(*group, F.col("a").alias("_lab")).agg(F.sum("n").alias("x"))
    cols = counts.groupBy(*group, F.col("b").alias("_lab")).agg(F.sum("n").alias("y"))
    chance = (rows.join(cols, [*group, "_lab"]).groupBy(*group)
              .agg(F.sum(F.col("x") * F.col("y")).alias("xy")))
    n2 = F.col("n") * F.col("n")
    xy = F.coalesce("xy", F.lit(0))
    observed = F.col("same") / F.col("n")
    # whole numbers decide whether chance is exactly one
    return total.join(chance, group, "left").select(
        *group, "n", observed.alias("observed"),
        F.when(xy != n2, (observed - xy / n2) / (1 - xy / n2)).alias("kappa"))


def agreement(grades: DataFrame) -> DataFrame:
    """Per two graders: shared pairs, exact and binary agreement, both kappas."""
    group = ["g1", "g2"]
    cells = grader_pairs(grades).groupBy(*group, F.col("grade1").alias("a"),
                                         F.col("grade2").alias("b")).agg(F.count("*").alias("n"))
    useful = lambda c: (F.col(c) >= 2).cast("int").alias(c)
    two = cells.select(*group, useful("a"), useful("b"), "n").groupBy(*group, "a", "b").agg(
        F.sum("n").alias("n"))
    four, half = kappa(cells, group), kappa(two, group)
    r = lambda c: F.round(c, 3)
    return four.alias("f").join(half.alias("h"), group).select(
        *group, F.col("f.n").alias("pairs"), r("f.observed").alias("exact"),
        r("h.observed").alias("binary"), r("h.kappa").alias("kappa_binary"),
        r("f.kappa").alias("kappa_4way"))


def consensus(grades: DataFrame, judge: str = "judge") -> DataFrame:
    """Per pair the low median of the human grades, from one count per grade."""
    n = [F.count(F.when(F.col("grade") == g, 1)) for g in range(4)]
    per = (grades.filter(F.col("grader") != judge).groupBy("query", "doc")
           .agg(F.count("*").alias("graders"), *[c.alias(f"n{g}") for g, c in enumerate(n)]))
    half = F.floor((F.col("graders") - 1) / 2)
    grade, seen = F.lit(3), F.lit(0)
    steps = []
    for g in range(3):
        seen = seen + F.col(f"n{g}")
        steps.append((seen > half, g))
    for cond, g in reversed(steps):
        grade = F.when(cond, F.lit(g)).otherwise(grade)
    return per.select("query", "doc", grade.alias("grade"), "graders")


def check_gold(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """Gold rows with ``kept``: a quote has to stand on its page (white space aside as
    single spaces), a row marked empty must have none. pages(pdf, page, text)."""
    from ..functions.text import squash
    quote = squash(F.coalesce("quote", F.lit("")))
    j = gold.join(pages.select("pdf", "page", squash("text").alias("_text")), ["pdf", "page"],
                  "left")
    on = F.col("_text").isNotNull()
    ok = F.when(F.coalesce("empty", F.lit(False)), on & (quote == "")).otherwise(
        on & (quote != "") & F.contains("_text", quote))
    return j.withColumn("kept", F.coalesce(ok, F.lit(False))).drop("_text")


def gold_counts(checked: DataFrame) -> DataFrame:
    """(doc, kept, failed)."""
    return checked.groupBy("doc").agg(F.count(F.when(F.col("kept"), 1)).alias("kept"),
                                      F.count(F.when(~F.col("kept"), 1)).alias("failed"))


def spot_check(checked: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """Up to n kept rows per document, picked by a hash of their key."""
    kept = checked.filter("kept").withColumn("_h", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256))
    return top_per(kept, ["doc"], [F.col("_h"), *[F.col(k) for k in key]], n, "pick").drop("_h")


def extraction_score(gold: DataFrame, found: DataFrame, matches: DataFrame, returned: DataFrame
                     ) -> DataFrame:
    """L10 per document: gold, found, recall, precision, f1, kept, returned, kept_rate.

    matches(gold_id, cand_id) come from quotes.gold_matches; returned(doc, returned) counts the
    raw answers."""
    hit = matches.select("gold_id").distinct().withColumn("_hit", F.lit(1))
    backed = matches.select("cand_id").distinct().withColumn("_ok", F.lit(1))
    g = gold.join(hit, "gold_id", "left").groupBy("doc", "split").agg(
        F.count("*").alias("gold"), F.count("_hit").alias("found"))
    c = found.join(backed, "cand_id", "left").groupBy("doc").agg(
        F.count("*").alias("kept"), F.count("_ok").alias("backed"))
    j = (g.join(c, "doc", "left").join(returned, "doc", "left")
         .fillna(0, ["kept", "backed", "returned"]))
    recall = F.col("found") / F.col("gold")
    precision = F.when(F.col("kept") > 0, F.col("backed") / F.col("kept")).otherwise(F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(
        F.lit(0.0))
    return j.select("doc", "split", "gold", "found", F.round(recall, 3).alias("recall"),
                    F.round(precision, 3).alias("precision"), F.round(f1, 3).alias("f1"),
                    "kept", "returned",
                    F.when(F.col("returned") > 0, F.round(F.col("kept") / F.col("returned"), 3))
                    .alias("kept_rate"))


def missed(gold: DataFrame, matches: DataFrame) -> DataFrame:
    """Gold rows nothing was found for."""
    return gold.join(matches.select("gold_id").distinct(), "gold_id", "left_anti")


def extraction_summary(per_doc: DataFrame) -> DataFrame:
    """One row: documents, micro recall, macro figures per split."""
    macro = lambda split, c: F.round(F.avg(F.when(F.col("split") == split, F.col(c))), 3)
    return per_doc.agg(
        F.count("*").alias("docs"), F.sum("gold").alias("gold"),
        F.round(F.sum("found") / F.sum("gold"), 3).alias("recall_micro"),
        macro("train", "recall").alias("recall_macro_train"),
        macro("holdout", "recall").alias("recall_macro_holdout"),
        macro("holdout", "precision").alias("precision_macro_holdout"),
        macro("holdout", "f1").alias("f1_macro_holdout"))


def holdout_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """U4: documents held out on one side only."""
    held = lambda df: df.filter(F.col("split") == "holdout").select("doc").distinct()
    a, b = held(old), held(new)
    return a.join(b, "doc", "left_anti").unionByName(b.join(a, "doc", "left_anti"))


def ship_gate(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (differing, old_recall, new_recall, ship): better on the same held-out
    documents, or it does not ship."""
    side = lambda df, n: df.filter(F.col("split") == "holdout").select(
        "doc", F.col("recall").alias(n)).withColumn(f"{n}_in", F.lit(1))
    both = side(old, "old").join(side(new, "new"), "doc", "full_outer")
    one = both.agg(F.count(F.when(F.col("old_in").isNull() | F.col("new_in").isNull(), 1))
                   .alias("differing"), F.round(F.avg("old"), 3).alias("old_recall"),
                   F.round(F.avg("new"), 3).alias("new_recall"))
    return one.withColumn("ship", F.coalesce(
        (F.col("differing") == 0) & (F.col("new_recall") > F.col("old_recall")), F.lit(False)))

"""Filter interaction audit: what each filter removes under every order of the filters.

Documents become cells: one per part and set of failed filters, with weighted counts. Every cell is
folded over the array of all orders, which travels with the plan: an order folds over its letters
and gives one struct of counts per step, 600 for five filters. The arrays of a part's cells, 32 at
most, are added element by element.

Defined cases. A null text counts as empty, a null part as the empty string. A document is a copy
if a smaller doc_id has the same text anywhere in the table; a null doc_id is neither smaller nor a
copy, and rows of the same doc_id are not copies of one another. Repeated rows are counted each. A
document is good or toxic if any of its labels says so. An empty table gives no rows. Other columns
are ignored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

LETTERS = "ABCDE"
#: fixed values of the filters: least words, distinct words and capitals in hundredths, signs
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 100, 80, 10, "[#$%&*|]"
CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """The letters of A to D that a text fails, in order."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, CAPS, ""))
    # one array element, so that the words are counted once
    fails = F.transform(F.array(counts), lambda c: F.concat(
        F.when(c["n"] < LEAST_WORDS, "A").otherwise(""),
        F.when(100 * c["distinct"] < DISTINCT * c["n"], "B").otherwise("")))[0]
    return F.concat(fails, F.when(100 * capitals > CAPITALS * F.length(text), "C").otherwise(""),
                    F.when(text.rlike(SIGNS), "D").otherwise(""))


def failing(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, failed) of each document; ``failed`` has the letters of A to E.

    Texts are read once; what follows moves their digests. The first document of a text is found by
    an equality of text and id, so a text that many documents share is no hot key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = stage(docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"), text_failures(text).alias("failed")), "failures")
    first = read.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return read.join(first, ["same", "doc_id"], "left").select(
        "doc_id", "part", F.concat("failed", F.when(copy, "E").otherwise("")).alias("failed"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, docs, good, toxic): documents of each part and set of failed filters."""
    of = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    return failed.join(of, "doc_id", "left").groupBy("part", "failed").agg(
        F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def orders(letters: str = LETTERS) -> Column:
    """All orders of the letters as an array of strings, in the order of the alphabet."""
    each = F.split(F.lit(letters), "")
    longer = lambda done: F.flatten(F.transform(done, lambda o: F.transform(
        F.filter(each, lambda c: ~F.contains(o, c)), lambda c: F.concat(o, c))))
    return F.aggregate(each, F.array(F.lit("")), lambda done, _: longer(done))


def steps(order: Column, failed: Column, docs: Column, good: Column, toxic: Column) -> Column:
    """What one order does with one cell: a struct per step."""
    none = F.lit(0).cast("long")

    def step(before: Column, letter: Column) -> Column:
        fails, gone = F.contains(failed, letter), before["gone"]
        out = F.struct(
            order.alias("filter_order"), letter.alias("letter"),
            F.when(gone | fails, none).otherwise(docs).alias("kept"),
            F.when(fails & ~gone, docs).otherwise(none).alias("removed"),
            F.when(fails & gone, docs).otherwise(none).alias("redundant"),
            F.when(failed == letter, docs).otherwise(none).alias("unique_fails"),
            F.when(fails & ~gone, good).otherwise(none).alias("good_lost"),
            F.when(fails & ~gone, toxic).otherwise(none).alias("toxic_lost"))
        return F.struct((gone | fails).alias("gone"), F.concat(before["steps"], F.array(out)).alias("steps"))

    nothing = F.array().cast("array<struct<filter_order:string,letter:string,"
                             + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(False).alias("gone"), nothing.alias("steps"))
    return F.aggregate(F.split(order, ""), start, step, lambda s: s["steps"])


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, counts…, shapley) from (part, failed, docs, good, toxic)."""
    folded = cells.select("part", F.flatten(F.transform(orders(letters), lambda o: steps(
        o, F.col("failed"), F.col("docs"), F.col("good"), F.col("toxic")))).alias("weighted"))
    added = lambda a, b: F.struct(a["filter_order"].alias("filter_order"), a["letter"].alias("letter"), *[
        (a[c] + b[c]).alias(c) for c in COUNTS])
    # as many arrays a part as there are sets of letters
    merged = folded.groupBy("part").agg(F.collect_list("weighted").alias("all")).select(
        "part", F.aggregate(F.slice("all", 2, 1 << 30), F.element_at("all", 1),
                            lambda acc, x: F.zip_with(acc, x, added)).alias("steps"))
    removed = lambda c: F.aggregate(F.filter("steps", lambda s: s["letter"] == c), F.lit(0).cast("long"),
                                    lambda acc, s: acc + s["removed"])
    out = merged.withColumn("shares", F.struct(*[removed(c).alias(c) for c in letters])).select("part", "shares", F.posexplode("steps").alias("at", "s"))
    share = reduce(lambda when, c: when.when(F.col("s.letter") == c, F.col(f"shares.{c}")), letters[1:],
                   F.when(F.col("s.letter") == letters[0], F.col(f"shares.{letters[0]}")))
    return out.select("part", "s.filter_order", (F.col("at") % len(letters) + 1).cast("int").alias("step"),
                      *[f"s.{c}" for c in COUNTS], share.alias("shapley"))


ORACLE = r"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
f as (select part, doc_id, len(ws) < 100 as a, 100 * len(list_distinct(ws)) < 80 * len(ws) as b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
  coalesce(doc_id > min(doc_id) over (partition by t), false) as e from d),
l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels where doc_id is not null group by doc_id),
cell as (select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
  || case when d then 'D' else '' end || case when e then 'E' else '' end as failed, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from f left join l using (doc_id) group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select p.c || q.c || r.c || s.c || t.c as filter_order from x p, x q, x r, x s, x t
  where p.c not in (q.c, r.c, s.c, t.c) and q.c not in (r.c, s.c, t.c) and r.c not in (s.c, t.c) and s.c <> t.c),
st as (select filter_order, step, substr(filter_order, step, 1) as c, '[' || left(filter_order, step - 1) || '0]' as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
m as (select part, filter_order, step, c, n, good, toxic, failed = c as alone, contains(failed, c) as fails, regexp_matches(failed, before) as gone from cell, st),
r as (select part, filter_order, step, c, cast(coalesce(sum(n) filter (not gone and not fails), 0) as bigint) as kept, cast(coalesce(sum(n) filter (fails and not gone), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (fails and gone), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (alone), 0) as bigint) as unique_fails,
  cast(coalesce(sum(good) filter (fails and not gone), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (fails and not gone), 0) as bigint) as toxic_lost from m group by all)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, c) as bigint) as shapley from r"""

"""Tables written for other tools: corpora, training examples, calibration text, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# fixed values: grade of a reviewed relationship
GRADES = {"direct_implementation": 3, "budget": 2, "supporting": 2, "related_but_indirect": 1,
          "probably_unrelated": 0}


def export_corpus(evidence: DataFrame, commitments: DataFrame, links: DataFrame
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries and graded pairs out of reviewed evidence."""
    docs = evidence.filter(F.coalesce("snippet", F.lit("")) != "").select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), "url", "title",
        F.col("snippet").alias("text"))
    asked = commitments.join(evidence.select(F.col("commitment_id").alias("id")), "id",
                             "left_semi")
    queries = asked.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "title",
                           tx.query_text("title", "summary", "code").alias("text"))
    grade = F.lit(None).cast("int")
    for rel, g in GRADES.items():
        grade = F.when(F.col("relationship") == rel, F.lit(g)).otherwise(grade)
    reviewed = links.filter("review_status = 'accepted' and relationship is not null").select(
        F.concat(F.lit("c"), F.col("commitment_id").cast("string")).alias("query"),
        F.concat(F.lit("e"), F.col("evidence_id").cast("string")).alias("doc"),
        grade.alias("grade"), F.lit("review").alias("by"))
    return docs, queries, reviewed.join(docs.select(F.col("id").alias("doc")), "doc",
                                        "left_semi")


def shown(page: Column, excerpt: Column) -> Column:
    """The excerpt is in the part of the page a reader model gets to see."""
    return tx.has_text(excerpt) & F.contains(
        tx.squash(F.left(page, F.lit(tx.PAGE_CHARS))), tx.squash(excerpt))


def _example(rows: DataFrame, keys: list[str], use: Column, item: Column, order: str,
             prompt: Column) -> DataFrame:
    """One example per page: the prompt and its items as JSON, in order. A page's items are
    distinct quotes of at most 6000 characters of text."""
    items = F.transform(F.array_sort(F.collect_list(F.when(use, F.struct(
        F.col(order).alias("o"), item.alias("i"))))), lambda x: x["i"])
    answer = F.to_json(F.struct(items.alias("items")))
    return rows.groupBy(*keys).agg(F.first(prompt).alias("prompt"), answer.alias("answer"))


def export_training(candidates: DataFrame, commitments: DataFrame, pages: DataFrame,
                    holdout: DataFrame, intro: str) -> DataFrame:
    """(document_id, page, prompt, answer) for every fully reviewed page.

    Accepted candidates become items, in the wording a reviewer gave them; a page with only
    rejected ones gets an empty answer; a page with an open candidate, a missing page and held
    out documents are left out."""
    edited = commitments.filter(F.col("candidate_id").isNotNull()).select(
        F.col("candidate_id").alias("id"), F.col("kind").alias("_kind"),
        F.col("title").alias("_title"))
    page = pages.select("document_id", F.col("page_number").alias("source_page"),
                        F.col("text").alias("_page"))
    unread = F.col("review_status") == "unreviewed"
    open_pages = candidates.filter(unread).select("document_id", "source_page").distinct()
    rows = (candidates.join(holdout.select("document_id"), "document_id", "left_anti")
            .join(open_pages, ["document_id", "source_page"], "left_anti")
            .join(page, ["document_id", "source_page"]).join(edited, "id", "left"))
    kind, title = F.coalesce("_kind", "suggested_type"), F.coalesce("_title", "normalized_title")
    quote = F.left("source_excerpt", F.lit(300))
    item = F.struct(kind.alias("type"), F.left(title, F.lit(120)).alias("normalized_title"),
                    F.left("text", F.lit(400)).alias("text"), F.col("source_page").alias("page"),
                    quote.alias("excerpt"))
    use = ((F.col("review_status") == "accepted") & tx.valid_kind(kind)
           & shown(F.col("_page"), quote))
    prompt = F.concat(F.lit(intro), tx.page_block("source_page", "_page"))
    return _example(rows, ["document_id", "source_page"], F.coalesce(use, F.lit(False)), item,
                    "id", prompt).withColumnRenamed("source_page", "page")


def export_gold_training(gold: DataFrame, pages: DataFrame, intro: str, order: str
                         ) -> DataFrame:
    """(doc, pdf, lang, page, prompt, answer) from the train split of checked gold keys."""
    rows = gold.filter("split = 'train'").join(
        pages.select("pdf", "page", F.col("text").alias("_page")), ["pdf", "page"])
    quote = F.left("quote", F.lit(300))
    item = F.struct(F.col("kind").alias("type"), F.left("title", F.lit(120))
                    .alias("normalized_title"), F.left("quote", F.lit(400)).alias("text"),
                    F.col("page"), quote.alias("excerpt"))
    use = ~F.coalesce("empty", F.lit(False)) & shown(F.col("_page"), quote)
    prompt = F.concat(F.lit(intro), tx.page_block("page", "_page"))
    return _example(rows, ["doc", "pdf", "lang", "page"], F.coalesce(use, F.lit(False)), item,
                    order, prompt)


def export_calibration(chunks: DataFrame, n: int = 512, min_chars: int = 600,
                       text: str = "text") -> DataFrame:
    """N distinct long texts in the order of their hash, each task keeping its first n."""
    long = chunks.select(tx.strip(text).alias("text")).filter(F.length("text") >= min_chars)
    return long.distinct().orderBy(F.sha2("text", 256)).limit(n)


def write_rankings(ranked: DataFrame, path: str) -> None:
    """Full rankings, one folder per system."""
    ranked.write.mode("overwrite").partitionBy("system").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A metric table as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_pool(pairs: DataFrame, path: str) -> None:
    """Pairs still to be graded, sorted."""
    pairs.orderBy("query", "doc").write.mode("overwrite").json(path)

"""Pages of documents: order, windows, assembly, links between pages and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def positions(df: DataFrame, group: list[str], order: str, out: str = "position",
              width: int = 10_000) -> DataFrame:
    """0-based place of each row in its group by an integer column, without putting a whole
    group in one task: rows are numbered inside ranges of ``width`` order values, and each
    range starts where the counts of the ranges before it end."""
    rng = F.floor(F.col(order) / width).alias("_range")
    df = df.withColumn("_range", rng)
    sizes = df.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_range",
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_range").orderBy(order)
    return (df.withColumn("_i", F.row_number().over(inside) - 1)
            .join(starts, [*group, "_range"])
            .withColumn(out, F.col("_start") + F.col("_i")).drop("_range", "_start", "_i"))


def page_windows(pages: DataFrame, width: int) -> DataFrame:
    """P10: consecutive pages of a document, ``width`` at a time, in list order."""
    if width < 1:
        raise ValueError("a window holds at least one page")
    return (positions(pages, ["document_id"], "page_number")
            .withColumn("window", F.floor(F.col("position") / width).cast("int"))
            .drop("position"))


def page_prompt(pages: DataFrame, width: int, intro: str, language: str) -> DataFrame:
    """One text per window: the intro with the language filled in, then its pages in order.
    A window holds ``width`` pages of at most 6000 characters."""
    block = F.struct("page_number", tx.page_block("page_number", "text").alias("block"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]),
                        "\n\n")
    return (page_windows(pages, width).groupBy("document_id", "window")
            .agg(F.concat(F.lit(intro.format(language=language)), body).alias("prompt")))


def page_markdown(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text): each page led by its marker. A document is its pages
    in order, joined by a blank line; every marker is a hard border for chunking anyway, so no
    task has to build a whole document."""
    return pages.select("document_id", "page_number", F.concat(
        F.lit("<!-- page "), F.col("page_number").cast("string"), F.lit(" -->\n"),
        F.col("text")).alias("text"))


def halved(pages: DataFrame) -> DataFrame:
    """The halves of each page that has two lines at least."""
    return pages.select("document_id", "page_number",
                        F.posexplode(tx.halves("text")).alias("half", "text"))


def allowed(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address is http(s), carries no credentials and lies on one of
    ``domains(domain)`` or below. Each distinct host is looked up once, by equality on its
    dot-suffixes."""
    hosts = df.select(tx.host(url).alias("_host")).distinct()
    ok = (hosts.select("_host", F.explode(tx.host_suffixes(F.col("_host"))).alias("domain"))
          .join(domains.select("domain").distinct(), "domain", "left_semi")
          .select("_host").distinct())
    return (df.filter(tx.web_url(url)).withColumn("_host", tx.host(url))
            .join(ok, "_host", "left_semi").drop("_host"))


def clipped(pages: DataFrame, key: str, name: str, limit: int, text: str = "text") -> DataFrame:
    """Text up to the safety limit, and a warning where there was more."""
    long = F.length(text) > limit
    return pages.select(key, F.left(F.col(text), F.lit(limit)).alias(text),
                        F.when(long, F.concat(F.col(name), F.lit(
                            f" is larger than the safety limit ({limit:,} chars), only the "
                            "first part was searched."))).alias("warning"))

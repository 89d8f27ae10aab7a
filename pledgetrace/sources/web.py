"""Web pages and sitemaps that have been fetched: text, title, date, documents listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stage

# fixed values: parts of a page that are not its text
BOILERPLATE = ("script", "style", "noscript", "template", "svg", "nav", "header", "footer",
               "aside", "form", "iframe")
BLOCKS = ("p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "li",
          "ul", "ol", "table", "tr", "td", "th", "br", "blockquote", "pre", "figure")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": "\"", "&#39;": "'",
            "&apos;": "'", "&amp;": "&"}


def _plain(html: Column) -> Column:
    """Markup to text: boilerplate out, blocks on lines of their own, entities resolved."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?is)<({'|'.join(BOILERPLATE)})\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<head\b.*?</head\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    return _decoded(out)


def _decoded(text: Column) -> Column:
    for name, ch in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(ch))
    return text


def read_html(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds title (else the address), text and published_on; pages without text go, a bad
    date costs only the date. All expressions, no Python."""
    title = tx.squash(_decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))
    text = F.regexp_replace(_plain(F.col(html)), r"[ \t\x0b\f\r]+", " ")
    text = tx.strip(F.regexp_replace(text, r" ?\n[ \n]*", "\n"))
    stamp = r"(?is)<meta[^>]*(?:published_time|date|dc\.date)[^>]*content=[\"'](\d{4}-\d{2}-\d{2})"
    mark = r"(?is)<time[^>]*datetime=[\"'](\d{4}-\d{2}-\d{2})"
    day = F.coalesce(F.nullif(F.regexp_extract(html, stamp, 1), F.lit("")),
                     F.nullif(F.regexp_extract(html, mark, 1), F.lit("")))
    return (pages.withColumn("title", F.when(title != "", title).otherwise(F.col(url)))
            .withColumn("text", text).withColumn("published_on", F.try_to_date(day, "yyyy-MM-dd"))
            .filter(F.col("text") != "").drop(html))


LINK = r"(?is)<(?:[\w.-]+:)?(loc|link|enclosure)\b([^>]*?)(?:/>|>(.*?)</(?:[\w.-]+:)?\1\s*>)"


def listed_links(maps: DataFrame) -> DataFrame:
    """Links of fetched sitemaps and feeds maps(url, xml): (map_url, is_index, tag, pos, url).

    Files with a document type or entities are refused, files that are not well-formed enough
    to have a root are skipped."""
    safe = ~F.upper("xml").rlike(r"<!DOCTYPE|<!ENTITY")
    root = F.regexp_extract("xml", r"(?is)\A\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*)*"
                                   r"<(?:[\w.-]+:)?([\w.-]+)", 1)
    got = [F.regexp_extract_all("xml", F.lit(LINK), F.lit(i)) for i in (1, 2, 3)]
    rows = (maps.filter(safe & (root != ""))
            .select(F.col("url").alias("map_url"), (root == "sitemapindex").alias("is_index"),
                    F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(
                        got, ("tag", "attrs", "body"))])).alias("pos", "l")))
    attr = lambda n: F.nullif(F.regexp_extract("l.attrs", rf"\b{n}=[\"']([^\"']*)[\"']", 1),
                              F.lit(""))
    body = F.regexp_replace("l.body", r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    tag = F.lower("l.tag")
    raw = F.when(tag == "enclosure", attr("url")).otherwise(F.coalesce(attr("href"), body))
    raw = tx.strip(_decoded(raw))
    base = F.regexp_extract("map_url", r"\A(https?://[^/]+)", 1)
    full = (F.when(raw.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), raw)
            .when(raw.startswith("//"), F.concat(F.regexp_extract("map_url", r"\A(https?:)", 1), raw))
            .when(raw.startswith("/"), F.concat(base, raw))
            .otherwise(F.concat(F.regexp_extract("map_url", r"\A(.*/)", 1), raw)))
    return rows.select("map_url", "is_index", tag.alias("tag"), "pos", full.alias("url")).filter(
        F.coalesce(raw, F.lit("")) != "")


def discover_documents(maps: DataFrame, domains: DataFrame, max_maps: int = 20,
                       max_urls: int = 200) -> DataFrame:
    """PDF links on allowed domains found in fetched maps(url, xml), starting from each
    domain's sitemap.xml and feed/ and following index files: (url, title, publisher).

    Index files are followed until a level meets no new file, or ``max_maps`` are met. At most
    ``max_maps`` files are read, in the order they are met, and ``max_urls`` documents kept: both
    are limits of the search itself."""
    from ..operators.pages import allowed
    links = allowed(listed_links(maps), domains)
    known = maps.select(F.col("url").alias("map_url")).distinct()
    seeds = domains.select("domain", F.posexplode(F.array(F.lit("sitemap.xml"), F.lit("feed/")))
                           .alias("n", "file"))
    level = seeds.select(
        F.concat(F.lit("https://"), "domain", F.lit("/"), "file").alias("map_url"),
        F.array(F.struct(F.col("domain").alias("m"), F.col("n").cast("bigint").alias("i")))
        .alias("path"))
    # files are met level by level; a file met twice is read once, where it came first
    first = lambda df: df.join(known, "map_url", "left_semi").groupBy("map_url").agg(F.min("path").alias("path"))
    level = stage(first(level), "maps")
    met, n = level, level.count()
    index = links.filter("is_index and tag = 'loc'")
    while n < max_maps:
        children = index.join(level, "map_url").select(
            F.col("url"), F.array_append("path", F.struct(
                F.col("map_url").alias("m"), F.col("pos").cast("bigint").alias("i"))).alias("path"))
        level = stage(first(children.withColumnRenamed("url", "map_url").join(met, "map_url", "left_anti")), "maps")
        new = level.count()
        if not new:
            break
        met, n = met.unionByName(level), n + new
    order = F.struct(F.size("path").alias("depth"), "path")
    read = met.select("map_url", order.alias("o")).orderBy("o").limit(max_maps)
    path = F.lower(F.try_parse_url("url", F.lit("PATH")))
    pdfs = (links.join(read, "map_url").filter(
        ~(F.col("is_index") & (F.col("tag") == "loc")) & path.endswith(".pdf"))
        .groupBy("url").agg(F.min(F.struct("o", "pos")).alias("at")).orderBy("at").limit(max_urls))
    return pdfs.select("url", F.substring_index(F.try_parse_url("url", F.lit("PATH")), "/", -1)
                       .alias("title"), tx.host("url").alias("publisher"))

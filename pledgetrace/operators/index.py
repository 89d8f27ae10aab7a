"""Passages with their vectors, kept between runs and made again only where a page changed.

The store is a Parquet table in buckets of the page. A row belongs to a page and a content key, which
says by which model, in what size and from which text it was made; so what is stored never has to
be checked against the text again. A run embeds the pages whose key is not there and writes only the
buckets that these pages are in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokens import HashedVectors
from ..session import stage
from .chunking import LIMIT, OVERLAP, chunk
from .retrieval import embed, missing_vectors

BUCKETS = 64
COLUMNS = ["page_id", "embed_model", "model", "chunk_index", "text_key", "chunk", "vector"]


def stored_passages(spark: SparkSession, path: str) -> DataFrame | None:
    """The store, or None where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def index_pages(pages: DataFrame, path: str, *, model: str = HashedVectors.model,
                provider: Callable[[], Callable] = HashedVectors, limit: int = LIMIT,
                overlap: int = OVERLAP, buckets: int = BUCKETS) -> DataFrame:
    """The passages of pages(page_id, text) with vectors, from the store at ``path``
    as far as they are there. Passages of a page's earlier texts by the same model go when the page
    is written again; those by other models stay."""
    spark = pages.sparkSession
    key = tx.content_key(F.lit(model), limit, "text")
    keyed = pages.select("page_id", "text").filter(tx.has_text("text")).withColumn("embed_model", key)
    stored = stored_passages(spark, path)
    new = keyed if stored is None else missing_vectors(keyed.drop("embed_model"), stored, key)
    new = stage(new, "new")
    if not new.isEmpty():
        # bucketed like the store that is there
        bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int").alias("bucket")
        made = chunk(new, limit=limit, overlap=overlap).withColumn("model", F.lit(model)).withColumn(
            "vector", embed("chunk", provider)).select(*COLUMNS, bucket)
        if stored is not None:
            # one row per bucket
            touched = F.broadcast(new.select(bucket).distinct())
            old = stored.join(touched, "bucket", "left_semi").join(
                new.select("page_id", F.lit(model).alias("model")).distinct(), ["page_id", "model"], "left_anti")
            made = made.unionByName(old.select(*COLUMNS, "bucket"))
        # written out first: what is read below is replaced
        (stage(made, "made").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))
    whole = stored_passages(spark, path)
    if whole is None:
        return chunk(new, limit=limit, overlap=overlap).withColumn("vector", F.lit(None).cast("array<float>")).select(
            "page_id", "chunk_index", "text_key", "chunk", "vector")
    return whole.join(keyed.select("page_id", "embed_model").distinct(), ["page_id", "embed_model"], "left_semi").select(
        "page_id", "chunk_index", "text_key", "chunk", "vector")


def passages_of_pages(stored: DataFrame, pages: DataFrame, urls: DataFrame | None = None,
                      key: Column | None = None) -> DataFrame:
    """stored(page_id, embed_model, …) with url and title of their pages(page_id, url, title, …).

    ``urls`` is a table with the urls that count, repeated ones count once; ``key`` is the content key
    as a column of pages, and passages stored under another one (an earlier text, another model) are
    left out. Passages of unknown pages, and null urls or keys, give no row."""
    known = pages if urls is None else pages.join(urls.select("url"), "url", "left_semi")
    on = ["page_id"]
    if key is not None:
        known, on = known.withColumn("embed_model", key), ["page_id", "embed_model"]
    return stored.drop("url", "title").join(known.select(*on, "url", "title"), on)

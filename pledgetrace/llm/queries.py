"""One query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmarks, chats, digests, filters, hosts, keys, spelling
from .licenses import license_spans
from .pieces import encoded, load_vocabulary
from .quality import fit_on_labels, learnable, quality_scores
from .registry import ORACLES, QUERIES, query
from .simhash import simhash_components
from .tables import fold, table
from .toxicity import fit_toxicity, labelled_sample, toxicity_scores
from .vectors import cosine_links
from .toxicity import learnable as toxic_learnable

__all__ = ["ORACLES", "QUERIES"]


def judged(scored: DataFrame, mod: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", mod) == held, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(*labelled_sample(docs, table(spark, sf_dir, "labels"), toxic_learnable()))
    return judged(toxicity_scores(docs, model, ["doc_id"]), 5, 0)


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"), learnable())
    return judged(quality_scores(docs, model, ["doc_id"]), 3, 1)


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op10_decontaminate", benchmarks.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return benchmarks.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query("op4_licenses")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_spans(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op6_pieces")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as piece ids under merge-dropout, checked by decoding."""
    return encoded(table(spark, sf_dir, "documents"), ["doc_id"], load_vocabulary())


@query("op8_hosts", hosts.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; a page's outcome is the quality label of the same id."""
    good = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return hosts.url_verdicts(table(spark, sf_dir, "pages"), good)


@query("op9_chats", chats.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.createDataFrame(chats.ADDED, "conv_id long, turn long, role string, text string")
    out = chats.conversations(chats.chain(rows.union(added)))
    turns, loss = chats.read_turns(F.col("formatted")), chats.loss_text(F.col("formatted"), F.col("loss_spans"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.expr("try_cast(tree as bigint)").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), "formatted",
    ).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
             F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
             F.length("formatted").cast("long").alias("formatted_chars"))


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; what the battery adds has no SQL."""
    return keys.digest(table(spark, sf_dir, "documents"))


@query("op5_vectors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return cosine_links(table(spark, sf_dir, "embeddings"))


@query("op11_spelling", spelling.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words, form and root."""
    return spelling.variants(spelling.run_counts(table(spark, sf_dir, "documents"))).select(
        "word", "n", "n_near", "form", "form_n", "root")


@query("op12_filters", filters.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language under every order."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filters.audit(filters.cells(filters.failing(docs), labels))


@query("op13_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents")
    return digests.edit_report(docs, digests.Rarity(digests.entropy_counts(docs)))

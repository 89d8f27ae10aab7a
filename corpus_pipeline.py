"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage reads its predecessor's rows as they were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgetrace.llm.benchmarks import clean_documents
from pledgetrace.llm.keys import redacted
from pledgetrace.llm.pieces import encoded, load_vocabulary
from pledgetrace.llm.quality import fit_on_labels, good_documents, learnable
from pledgetrace.llm.simhash import one_per_component
from pledgetrace.llm.tables import table
from pledgetrace.session import stage as written
from pledgetrace.session import tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    tune(spark)
    return good_documents(docs, fit_on_labels(docs, table(spark, sf_dir, "labels"), learnable()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest doc_id."""
    tune(spark)
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    tune(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind in brackets; n_chars follows the text."""
    tune(spark)
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids under merge-dropout."""
    tune(spark)
    return encoded(docs, ["doc_id"], load_vocabulary())


STAGES = [("quality", quality), ("simhash", near_duplicates), ("decontaminate", decontamination),
          ("secrets", secret_scan), ("pieces", pieces)]
#: no SQL says what a compression model or keyed merge-dropout decides
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

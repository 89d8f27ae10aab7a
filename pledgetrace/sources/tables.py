"""Stored tables: scans in their fixed orders, lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import plan_bytes

# fixed values: how each table is listed
ORDERS = {
    "candidates": [("source_page", "asc"), ("id", "asc")],
    "commitments": [("code", "asc"), ("id", "asc")],
    "links": [("score", "desc"), ("id", "asc")],
    "official_sources": [("sort_order", "asc"), ("id", "asc")],
    "documents": [("id", "asc")],
}
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def listing_order(table: str) -> list[Column]:
    """Nulls last either way, as the listings show them."""
    return [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last()
            for c, d in ORDERS[table]]


def scan(df: DataFrame, table: str, **equals) -> DataFrame:
    """Rows with the given column values (a None is no filter), in the table's order. The
    filters reach the Parquet scan; the order is a range sort over all tasks."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df.orderBy(*listing_order(table))


def lookup_many(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a list of ids; the list is broadcast only while it is small."""
    wanted = ids.select(key).distinct()
    if plan_bytes(wanted) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return df.join(wanted, key, "left_semi")

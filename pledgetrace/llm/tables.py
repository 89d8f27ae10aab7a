"""Reading the tables, folds, and handing Arrow texts to numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: texts handed to Python at a time; long texts make the batches large, not the number of rows
BATCH_ROWS = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def fold(key: str | Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(mod))


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept, null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and the n + 1 offsets of the texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
        if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def declared(df: DataFrame, keep: list[str]) -> list[str]:
    """Name and type of each kept column, for a schema string."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]


def with_columns(df: DataFrame, text: str, fn: Callable[[pa.Array], dict[str, pa.Array]], schema: str,
                 keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` plus the columns that ``fn`` makes from the batches of ``text``.

    Runs in Arrow batches where the rows are; ``schema`` names the new columns, which take the
    place of kept ones of the same name."""
    new_names = {part.split()[0] for part in schema.split(", ")}
    keep = [name for name in keep if name not in new_names]
    out = ", ".join([*declared(df, keep), schema])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch.column(batch.num_columns - 1))
            kept = {name: batch.column(i) for i, name in enumerate(keep)}
            yield pa.RecordBatch.from_pydict(kept | new)

    return df.select(*keep, F.col(text).alias(unused(df, "_text"))).mapInArrow(task, out)


def filtered(docs: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, for whose texts ``keep`` says so."""
    at = docs.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = "_" + name
    return name

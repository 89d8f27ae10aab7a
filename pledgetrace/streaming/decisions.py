"""Review decisions, evidence runs and contract states as they arrive.

Decisions and contract states are stateful aggregations: each micro-batch writes only the keys
it changed, into a folder of its own, and a reader folds the folders. Evidence runs are merged
into tables in hash buckets of the commitment, and a batch rewrites the buckets that it touches. A
batch that is run again after a failure overwrites its own folder, or merges rows that are there
already into themselves, so nothing is counted twice. A stream's checkpoint lies beside its output, so that a
second start on the same root goes on where the first one ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.merge import merge_budgets, merge_evidence, merge_links
from ..operators.trail import SEVERITY, _choose
from ..session import stage

#: folders of changes from which on they are folded into one
COMPACT_FROM = 16


def _numbers(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers n of the complete folders ``root/<prefix>n``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(prefix) and name[len(prefix):].isdigit() and fs.exists(done):
            found.append(int(name[len(prefix):]))
    return sorted(found)


def read_files(spark: SparkSession, folder: str, schema: str, name: str = "*.parquet",
               per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream of files."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", name)
            .option("maxFilesPerTrigger", per_trigger).parquet(folder))


def append_changes(changed: DataFrame, root: str) -> DataStreamWriter:
    """Write the rows each micro-batch changed."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return changed.writeStream.outputMode("update").foreachBatch(apply).option(
        "checkpointLocation", f"{root}/_checkpoint")


def read_changes(writer: DataStreamWriter, root: str, schema: str, spark: SparkSession,
                 fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Work off what is there and return all changes written so far.

    With ``fold``, which must give the same result on its own output, changes of many batches
    are folded into one base; a reader takes the newest base and the batches behind it."""
    writer.trigger(availableNow=True).start().awaitTermination()
    base = max(_numbers(spark, root, "base="), default=-1)
    later = [n for n in _numbers(spark, root, "batch=") if n > base]
    parts = [f"{root}/base={base}"] * (base >= 0) + [f"{root}/batch={n}" for n in later]
    if not parts:
        return spark.createDataFrame([], schema)
    changes = spark.read.schema(schema).parquet(*parts)
    if fold is None or len(later) < COMPACT_FROM:
        return changes
    columns = changes.columns
    fold(changes).select(*columns).write.mode("overwrite").parquet(f"{root}/base={later[-1]}")
    return spark.read.schema(schema).parquet(f"{root}/base={later[-1]}")


DECISIONS = ("link_id bigint, decision string, ts timestamp, event_id bigint")


def last_decisions(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("decision", "ts", "event_id"), F.struct("ts", "event_id"))
    return rows.groupBy("link_id").agg(last.alias("d")).select("link_id", "d.*")


def current_decisions(stream: DataFrame, root: str) -> DataStreamWriter:
    """ST1: stream(link_id, decision, ts, event_id) -> the last decision per link. The latest
    event time wins wherever it arrives, and a decision has no expiry, so the state is one row
    per link and late rows need no watermark to be right. ``last_decisions`` folds the result."""
    return append_changes(last_decisions(stream.select("link_id", "decision", "ts", "event_id")), root)


#: hash buckets of the commitment that evidence, links and figures are stored in
BUCKETS = 64
LINKS = ("id bigint, commitment_id bigint, evidence_id bigint, score double, suggested_relationship string, "
         "reasons array<string>, review_status string, relationship string")
BUDGETS = ("id bigint, evidence_id bigint, kind string, amount_raw string, fiscal_year int, description string, "
           "currency string")


def _bucket(commitment: str = "commitment_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(commitment), F.lit(buckets)).cast("int").alias("bucket")


class EvidenceStore:
    """Evidence, links and figures below ``root``, each a table in buckets of the commitment."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets
        self.schemas = {"evidence": schema, "links": LINKS, "budgets": BUDGETS}

    def read(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """A table, or of it the buckets that are named; those only are opened."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        schema = self.schemas[name] + ", bucket int"
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return rows if touched is None else rows.filter(F.col("bucket").isin(touched))

    def write(self, name: str, rows: DataFrame, touched: list[int] | None = None) -> DataFrame:
        """Replaces the buckets that ``rows`` are in; gives the table, or the buckets that are named, as it is
        then. ``rows`` may read these buckets: their files are replaced when all new ones are written."""
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(f"{self.root}/{name}"))
        return self.read(name, touched)

    def last_id(self, name: str) -> int:
        return int(self.read(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])  # one number

    def merge(self, batch: DataFrame, order: str, reviews: DataFrame | None = None) -> None:
        """M4, M5, M6 for the buckets of a batch. Of a key seen twice the last one by ``order`` counts."""
        keys = ["commitment_id", "url"]
        rest = [c for c in batch.columns if c not in keys]
        # dealt out before the order of equal rows is made, which is longer than the rows
        once = stage(batch.repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[
            F.to_json(F.struct(c)).alias(f"_{c}") for c in rest])).alias("_r")).select(*keys, "_r.*"), "batch")
        # at most as many as there are buckets
        touched = [r[0] for r in once.select(_bucket(buckets=self.buckets)).distinct().collect()]
        if not touched:
            return
        links = self.read("links", touched)
        decided = links.select("evidence_id", "review_status")
        decided = decided if reviews is None else decided.unionByName(reviews.select("evidence_id", "review_status"))
        rows = merge_evidence(self.read("evidence", touched).drop("bucket"), once, decided, self.last_id("evidence"))
        rows = self.write("evidence", rows.withColumn("bucket", _bucket(buckets=self.buckets)), touched)
        # a file much smaller than its rows: not sent whole through the driver
        found = once.join(rows.select(*keys, F.col("id").alias("evidence_id"), "bucket").hint("merge"), keys)
        if "money" in batch.columns:
            # a figure is in the bucket of its evidence, so the bucket goes along and is not looked up again
            new = found.select("evidence_id", "bucket", F.explode("money").alias("m")).select("evidence_id", "bucket", "m.*")
            out = merge_budgets(self.read("budgets", touched), new, decided, last_id=self.last_id("budgets"))
            self.write("budgets", out)
        # last, as the reviews above are read from these buckets
        if "score" in batch.columns:
            new = found.select(*[c for c in ("commitment_id", "evidence_id", "score", "suggested_relationship", "reasons")
                                 if c in found.columns])
            out = merge_links(links.drop("bucket"), new, self.last_id("links"))
            self.write("links", out.withColumn("bucket", _bucket(buckets=self.buckets)))


def evidence_runs(stream: DataFrame, root: str, schema: str, links: DataFrame | None,
                  order: str, buckets: int = BUCKETS, seen: str | None = None, late: str = "1 hour") -> DataStreamWriter:
    """ST2: every batch of found evidence is merged by M4, its ``score`` and suggestion by M5 and its
    ``money`` by M6: passages are refreshed, reviewed rows stay as they are. ``links`` are reviews
    beside the stored ones. With ``seen``, an event time, rows that were delivered twice within
    ``late`` are dropped on the way in."""
    if seen is not None:
        stream = stream.withWatermark(seen, late).dropDuplicatesWithinWatermark(["commitment_id", "url", order])

    def apply(batch: DataFrame, batch_id: int) -> None:
        EvidenceStore(batch.sparkSession, root, schema, buckets).merge(batch, order, links)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/_checkpoint")


def run_available(writer: DataStreamWriter, root: str, schema: str,
                  spark: SparkSession) -> DataFrame:
    """Work off what is there and return the stored evidence."""
    writer.trigger(availableNow=True).start().awaitTermination()
    return EvidenceStore(spark, root, schema).read("evidence").drop("bucket")


STATES = ("procurement_id string, rank int, status_evidence_id bigint")


def worst_states(rows: DataFrame) -> DataFrame:
    worst = F.max(F.struct("rank", (-F.col("status_evidence_id")).alias("neg")))
    return rows.groupBy("procurement_id").agg(worst.alias("w")).select(
        "procurement_id", "w.rank", (-F.col("w.neg")).alias("status_evidence_id"))


def artifact_states(stream: DataFrame, root: str) -> DataStreamWriter:
    """ST3: stream(procurement_id, evidence_id, polarity) -> per contract the most severe state
    and the lowest evidence that reached it. States only rise, so rows may come in any order
    and the folded result equals the batch rule."""
    rank = _choose(F.col("polarity"), {p: r for p, (_, r) in SEVERITY.items()}, 0)
    rows = stream.select("procurement_id", rank.cast("int").alias("rank"),
                         F.col("evidence_id").alias("status_evidence_id"))
    return append_changes(worst_states(rows), root)


def as_artifacts(states: DataFrame) -> DataFrame:
    """Stored states in the shape of the batch result."""
    status = _choose(F.col("rank"), {r: s for s, r in SEVERITY.values()}, "active")
    return states.select("procurement_id", status.alias("status"),
                         F.when(F.col("rank") > 0, F.col("status_evidence_id"))
                         .alias("status_evidence_id"))

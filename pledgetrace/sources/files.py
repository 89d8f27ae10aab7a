"""JSON lines, corpora, grade sheets and gazetteers as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip


def read_jsonl(spark: SparkSession, path: str, schema: str,
               allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """S3: one record per line, blank lines skipped; a malformed line or a value outside its
    enumeration fails the read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name, values in (allowed or {}).items():
        bad = F.col(name).isNotNull() & ~F.col(name).isin(*values)
        df = df.withColumn(name, F.when(bad, F.raise_error(F.concat(
            F.lit(f"{name} cannot be "), F.col(name)))).otherwise(F.col(name)))
    return df


def validated(df: DataFrame) -> DataFrame:
    """All rows read once before any is used, so that a bad last line stops the first write."""
    df.write.format("noop").mode("overwrite").save()
    return df


def corpus_tables(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-document corpus rows -> documents(doc, title, text), queries(query, text) and
    inline relevance (query, doc); a query without an id goes by its position."""
    docs = corpus.select(F.explode("documents").alias("d")).select(
        F.col("d.id").alias("doc"), F.coalesce("d.title", F.lit("")).alias("title"), "d.text")
    q = corpus.select(F.posexplode("queries").alias("pos", "q")).select(
        F.coalesce("q.id", F.col("pos").cast("string")).alias("query"), "q.text", "q.relevant")
    return docs, q.select("query", "text"), q.select("query", F.explode("relevant").alias("doc"))


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A corpus file; repeated document ids and relevance to unknown documents are errors."""
    raw = spark.read.schema(schemas.CORPUS).option("multiLine", True).option(
        "mode", "FAILFAST").json(path)
    docs, queries, relevant = corpus_tables(raw)
    if docs.groupBy("doc").count().filter("count > 1").limit(1).count():
        raise ValueError("document ids repeat")
    if relevant.join(docs, "doc", "left_anti").limit(1).count():
        raise ValueError("relevance names documents the corpus does not have")
    return docs, queries, relevant


HEADER, GRADE = r"\A=== \d+\. (\S+) / (\S+) ===\z", r"\A(?:grade|you):\s*([0-3])\b"


def grade_rows(lines: DataFrame) -> DataFrame:
    """lines(grader, pos, line) -> (grader, query, doc, grade). A grade belongs to the last
    header above it and uses it up; a blank grade is none; of a pair graded twice the last.

    With a column ``block``, lines are ordered by block and then pos, and only a block is walked
    in one task: the header that is open at its end is handed on, one row per block."""
    if "block" not in lines.columns:
        lines = lines.withColumn("block", F.lit(0))
    line, at = strip("line"), F.struct("block", "pos")
    head = F.when(line.rlike(HEADER), F.struct(
        F.regexp_extract(line, HEADER, 1).alias("query"),
        F.regexp_extract(line, HEADER, 2).alias("doc"), at.alias("at")))
    grade = F.nullif(F.regexp_extract(line, GRADE, 1), F.lit("")).cast("int")
    marked = lines.select("grader", "block", "pos", head.alias("h"), grade.alias("grade")).filter(
        "h is not null or grade is not null")
    before = Window.partitionBy("grader").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)  # one row per block
    opened = marked.groupBy("grader", "block").agg(
        F.max_by("h", F.when(F.col("h").isNotNull(), F.col("pos"))).alias("h")).select(
        "grader", "block", F.last("h", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("grader", "block").orderBy("pos")
    graded = (marked.withColumn("h", F.last("h", ignorenulls=True).over(inside))
              .filter("grade is not null").join(opened, ["grader", "block"])
              .withColumn("h", F.coalesce("h", "carried")).filter("h is not null"))
    first = graded.groupBy("grader", "h.query", "h.doc", "h.at").agg(F.min_by("grade", at).alias("grade"))
    return first.groupBy("grader", "query", "doc").agg(F.max_by("grade", "at").alias("grade"))


def read_grade_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Filled-in sheets, the grader is the file name, or X where files lie in a folder
    ``grader=X`` and follow one another by name. Large sheets are read by several tasks."""
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract("_metadata.file_path", r"/grader=([^/]+)/[^/]*\z", 1)
    name = F.regexp_extract(decoded(F.col("_metadata.file_name")), r"\A(.*?)(?:\.[^.]*)?\z", 1)
    # a folder's name is escaped once as a partition and once as an address
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.when(folder != "", decoded(decoded(folder))).otherwise(name).alias("grader"),
        F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    return grade_rows(lines)


# fixed values: map tags -> place kind
PLACE_KINDS = {"square": "square", "park": "park", "garden": "park"}


def _line(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


def _shape(kind: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def gazetteer(elements: DataFrame, area: str) -> DataFrame:
    """Map elements -> (kind, name, canonical_name, district, osm_id, geojson, source):
    nameless ones dropped, the first per (kind, name) kept."""
    e = elements.select(F.posexplode("elements").alias("pos", "e"))
    name = strip(F.coalesce(F.try_element_at("e.tags", F.lit("name")), F.lit("")))
    tag = F.coalesce(F.try_element_at("e.tags", F.lit("place")),
                     F.try_element_at("e.tags", F.lit("leisure")))
    kind = F.lit("street")
    for value, k in PLACE_KINDS.items():
        kind = F.when(tag == value, F.lit(k)).otherwise(kind)
    parts = F.transform(F.filter("e.members", lambda m: F.size(m["geometry"]) > 0),
                        lambda m: _line(m["geometry"]))
    points = F.col("e.geometry")
    closed = (F.size(points) > 3) & (F.element_at(points, 1) == F.element_at(points, -1))
    shape = (F.when(F.col("e.type") == "relation",
                    F.when(F.size(parts) > 0, _shape("MultiLineString", parts)))
             .when(F.size(points) > 0, F.when(closed, _shape("Polygon", F.array(_line(points))))
                   .otherwise(_shape("LineString", _line(points)))))
    rows = e.select("pos", kind.alias("kind"), name.alias("name"), F.concat_ws(
        "/", F.col("e.type"), F.col("e.id").cast("string")).alias("osm_id"),
        shape.alias("geojson")).filter(F.col("name") != "")
    first = rows.groupBy("kind", "name").agg(
        F.min_by(F.struct("osm_id", "geojson"), "pos").alias("f"))
    return first.select("kind", "name", F.col("name").alias("canonical_name"),
                        F.lit(area).alias("district"), "f.osm_id", "f.geojson",
                        F.lit("osm").alias("source"))


def load_gazetteer(spark: SparkSession, path: str, area: str) -> DataFrame:
    """A saved map answer."""
    return gazetteer(spark.read.schema(schemas.OVERPASS).option("multiLine", True).json(path),
                     area)

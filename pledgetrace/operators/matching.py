"""Commitment against passage: shared names, score, relationship hint. All per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _col, let
from ..session import stage

# fixed values: weights and similarity bands
W_SIMILARITY, W_ORG, W_PLACE, W_YEAR = 0.60, 0.15, 0.15, 0.10
DIRECT, SUPPORTING, INDIRECT = 0.58, 0.48, 0.40
FEATURES = ("struct<similarity:double,shared_organisations:array<string>,"
            "shared_locations:array<string>,shared_dates:array<string>>")


def lowered(names: Column | str) -> Column:
    return F.array_distinct(F.transform(_col(names), lambda n: F.trim(F.lower(n))))


def shared_names(a: Column, b: Column) -> Column:
    """Names both lists hold, also where one contains the other; the shorter spelling."""
    meets = lambda x, y: (x == y) | ((F.length(x) > 4) & (F.length(y) > 4)
                                     & (F.contains(x, y) | F.contains(y, x)))
    pairs = let(b, lambda bs: F.flatten(F.transform(a, lambda x: F.transform(
        F.filter(bs, lambda y: meets(x, y)),
        lambda y: F.when(F.length(y) < F.length(x), y).otherwise(x)))))
    return F.array_sort(F.array_distinct(pairs))


def features(similarity: Column, orgs: tuple[Column, Column], places: tuple[Column, Column],
             dates: tuple[Column, Column]) -> Column:
    """Everything the score looks at, as one struct."""
    return F.struct(F.round(similarity, 4).alias("similarity"),
                    shared_names(*orgs).alias("shared_organisations"),
                    shared_names(*places).alias("shared_locations"),
                    F.array_sort(F.array_intersect(*dates)).alias("shared_dates"))


def match_score(f: Column) -> Column:
    """Plain weighted sum, at most two shared names of a sort count."""
    part = lambda name: F.least(F.size(f[name]), F.lit(2)) / 2
    total = (W_SIMILARITY * f["similarity"] + W_ORG * part("shared_organisations")
             + W_PLACE * part("shared_locations") + W_YEAR * part("shared_dates"))
    return F.least(F.lit(1.0), F.round(total, 4))


def suggest_relationship(f: Column, has_budget: Column) -> Column:
    """struct(relationship, reasons)."""
    sim = f["similarity"]
    named = (F.size(f["shared_organisations"]) > 0) | (F.size(f["shared_locations"]) > 0)
    relationship = (F.when((sim >= DIRECT) & named, F.lit("direct_implementation"))
                    .when(has_budget & (sim >= INDIRECT), F.lit("budget"))
                    .when(sim >= SUPPORTING, F.lit("supporting"))
                    .when(sim >= INDIRECT, F.lit("related_but_indirect"))
                    .otherwise(F.lit("probably_unrelated")))
    closeness = (F.when(sim >= DIRECT, F.lit("the text is a close match"))
                 .when(sim >= SUPPORTING, F.lit("the text is fairly similar"))
                 .when(sim >= INDIRECT, F.lit("some text overlap"))
                 .otherwise(F.lit("little text in common")))
    listed = lambda label, name: F.when(
        F.size(f[name]) > 0, F.concat(F.lit(label), F.array_join(f[name], ", ")))
    reasons = F.array_compact(F.array(
        closeness, listed("names the same organisation: ", "shared_organisations"),
        listed("same place: ", "shared_locations"), listed("same year: ", "shared_dates"),
        F.when(has_budget, F.lit("the page mentions a money figure"))))
    return F.struct(relationship.alias("relationship"), reasons.alias("reasons"))


def title_key(words: Column) -> Column:
    """One string per word set, so that equal sets are equal keys."""
    return F.array_join(F.array_sort(words), " ")


def _title_sets(titles: DataFrame, key: str, words: str) -> DataFrame:
    """(id, n, words, digits): each word set once, with its smallest key and its number of rows."""
    sets = (titles.filter(F.size(words) > 0)
            .groupBy(title_key(F.col(words)).alias("_set"))
            .agg(F.min(key).alias("id"), F.count("*").alias("n")))
    digits = F.array_join(F.filter("words", lambda w: w.rlike(r"\A\p{Nd}+\z")), " ")
    return stage(sets.withColumn("words", F.split("_set", " ")).withColumn("digits", digits), "titles")


def _near_sets(sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, similarity) of different sets that share four fifths of their union.

    Such sets share one of their rarest few words, and the first one they share stands early
    enough in both that the rest can still make up the overlap; sizes differ by a quarter at most,
    so a word's sets meet in blocks of like sizes. Only pairs that pass all this fetch words."""
    freq = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ordered = (sets.select("id", "digits", F.explode("words").alias("word")).join(freq, "word")
               .groupBy("id", "digits").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("o")))
    size = F.size("o")
    prefix = size - F.ceil(size * F.lit(0.8) - 1e-9).cast("int") + 1
    block = F.floor(F.log(size.cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")
    probes = stage(ordered.select("id", "digits", size.alias("size"), block.alias("block"), F.posexplode(
        F.slice("o", F.lit(1), prefix)).alias("at", "p")).select(
        "id", "digits", "size", "block", "at", F.col("p.word").alias("word")), "probes")
    small = probes.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "size", "at")], "digits", "word", "block")
    large = probes.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "size", "at")], "digits", "word",
                          F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    total = F.col("size_a") + F.col("size_b")
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    met = (small.join(large, ["digits", "word", "block"])
           .filter(F.struct("size_a", "id_a") < F.struct("size_b", "id_b"))
           .filter((F.col("size_a") * 5 >= F.col("size_b") * 4) & (rest * 9 >= total * 4))
           .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("words").alias(f"words_{c}"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    close = common / (F.size("words_a") + F.size("words_b") - common)
    return (met.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", close)
            .filter(F.col("similarity") >= 0.8).select("a", "b", "n_a", "n_b", "similarity"))


def near_titles(titles: DataFrame, key: str, words: str) -> DataFrame:
    """Pairs of different word sets that count as one document's title.

    Rows with the same word set are folded first (n rows, smallest key), so copies never
    multiply: (a, b, n_a, n_b, similarity), a and b the smallest keys."""
    return _near_sets(_title_sets(titles, key, words))


def title_classes(titles: DataFrame, key: str, words: str) -> DataFrame:
    """J15 as one row per title: (key, title_id, n_same, n_near, near_id).

    ``title_id`` is the smallest key with the same word set, ``n_same`` its rows, ``n_near`` the
    other sets that count as the same title, ``near_id`` the smallest key among them and itself.
    Null titles and those without words have no row."""
    sets = _title_sets(titles, key, words)
    pairs = stage(_near_sets(sets).select("a", "b"), "near")
    near = (pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("b").alias("_least")))
    classes = sets.join(near, "id", "left").select(
        "_set", F.col("id").alias("title_id"), F.col("n").alias("n_same"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.least("id", "_least").alias("near_id"))
    return (titles.filter(F.size(words) > 0).select(key, title_key(F.col(words)).alias("_set"))
            .join(classes, "_set").drop("_set"))

"""Gazetteer: place names in passages, streets behind parcel numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

MIN_NAME = 5
#: names that one automaton holds; more are looked for shard by shard
NAMES = 200_000


def place_names(places: DataFrame) -> DataFrame:
    """Distinct names of everything that is not a parcel."""
    return places.filter(F.col("kind") != "parcel").select("name").distinct()


def _shards(names: DataFrame) -> Iterator[list[str]]:
    """The names in lists of at most ``NAMES``."""
    first = [r["name"] for r in names.limit(NAMES + 1).collect()]
    if len(first) <= NAMES:
        yield first
        return
    names = stage(names, "names")
    n = -(-names.count() * 5 // (NAMES * 4))
    for i in range(n):
        yield [r["name"] for r in names.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == i).collect()]


class _Names:
    """Names as one automaton over their characters, upper and lower case alike."""

    def __init__(self, names: list[str]) -> None:
        import ahocorasick

        spelled = defaultdict(list)
        for name in names:
            spelled[name.lower()].append(name)
        self.automaton = ahocorasick.Automaton()
        for low, same in spelled.items():
            self.automaton.add_word(low, (len(low), same))
        if spelled:
            self.automaton.make_automaton()

    def held(self, text: str) -> list[str]:
        """The names that begin at the begin of a word."""
        low, out = text.lower(), set()
        for end, (size, same) in self.automaton.iter(low) if len(self.automaton) else ():
            before = low[end - size] if end >= size else " "
            if not (before.isalnum() or before == "_"):
                out.update(same)
        return sorted(out)


def mentions(passages: DataFrame, key: list[str], text: str, places: DataFrame) -> DataFrame:
    """(key, name) for every gazetteer name a passage holds; the name may not begin inside
    a word but may carry an ending.

    A passage is walked once, through an automaton of all names of a shard, where it is: nothing is
    joined or shuffled, so neither a frequent word nor a long gazetteer makes a large group."""
    names = place_names(places).filter(F.length("name") >= MIN_NAME)
    schema = ", ".join(f"`{k}` {passages.schema[k].dataType.simpleString()}" for k in key) + ", name string"
    rows, out = passages.select(*key, F.col(text).alias("_text")), None
    for shard in _shards(names):
        shared = passages.sparkSession.sparkContext.broadcast(shard)

        def task(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names = _Names(shared.value)
            for frame in frames:
                held = [names.held(t or "") for t in frame["_text"]]
                at = [i for i, h in enumerate(held) for _ in h]
                found = {k: frame[k].astype(object).iloc[at].reset_index(drop=True) for k in key}
                yield pd.DataFrame(found | {"name": pd.Series([n for h in held for n in h], dtype=object)})

        part = rows.mapInPandas(task, schema)
        out = part if out is None else out.unionByName(part)
    return out


def resolve_parcels(found: DataFrame, places: DataFrame) -> DataFrame:
    """found(key…, parcel, first_street) -> plus street: the best known place row
    (confirmed first, then lowest id), else the first street of the same passage."""
    known = (places.filter(F.col("kind") == "parcel").groupBy(F.col("name").alias("parcel"))
             .agg(F.min_by("canonical_name", F.struct(~F.col("confirmed"), F.col("id")))
                  .alias("_known")))
    return (found.join(known, "parcel", "left")
            .withColumn("street", F.coalesce("_known", "first_street"))
            .withColumn("new_place", F.col("_known").isNull() & F.col("first_street").isNotNull())
            .drop("_known"))


def first_streets(found: DataFrame, order: str) -> DataFrame:
    """Per new parcel the street it was first seen with; that one sticks."""
    return (found.filter("new_place").groupBy("parcel")
            .agg(F.min_by("street", order).alias("street")))

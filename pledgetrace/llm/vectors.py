"""Near-duplicate embeddings by product quantisation.

Unit vectors are dealt to inverted lists by their nearest coarse centre; the residual is coded in
PARTS subspaces. Two vectors at a cosine of at least t are at a distance of at most
r = sqrt(2 - 2 t). A vector searches the lists whose planes to its own list are within reach: r
itself would never lose a partner, but a partner lies in a direction of its own, of which only a
share of about 1 / sqrt(D) crosses a given plane. So the reach is DEVIATIONS * r / sqrt(D), at most
r, with D the effective dimension of the sample, and a link is found if either of its vectors
reaches the other's list. In a list, distances to the codes are summed from a table per subspace;
a code whose distance exceeds r by more than the coding error of its vector cannot be a partner.
The others are compared exactly.

Recall against brute force is 1 on the tables at hand; without ``deviations`` it is 1 on any.

Equal vectors are one vector with a count. A link that is found from both sides counts once, on
the side of the smaller list. Lists and their searches are cut into blocks, so that no list, however full, is one task, and of the links
found in a block only counts and a spanning forest leave the task.

Defined cases. Null vectors, vectors of zero length or of norm zero, and those with null, infinite
or not-a-number components link with nothing and are their own component. Vectors of different
lengths link with nothing of each other. Repeated rows are vectors of their own and link. A null
vec_id never names a component. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components

#: vectors of least hash that centres and codes are fitted on, vectors per list, most lists
SAMPLE, PER_LIST, LISTS = 16_384, 512, 1024
DEVIATIONS = 2.5
PARTS, CODES, ROUNDS = 8, 256, 8
#: vectors of a list and searches of it that meet in one task
BLOCK, SEARCHES = 256, 1024
SEED = 5


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``x`` (Lloyd's rounds from a random start; an empty centre stays)."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i:i + step] @ centres.T, axis=1) for i in range(0, len(x), step)]
                          or [np.zeros(0, np.int64)])


class Coder:
    """Coarse centres and residual codes of vectors of ``width`` components, a multiple of PARTS."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        rng = np.random.default_rng(SEED)
        self.centres = kmeans(sample, lists, rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.codes = [kmeans(part, CODES, rng) for part in np.split(rest, PARTS, axis=1)]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance of each vector to what its codes say)."""
        parts = np.split(x - self.centres[own], PARTS, axis=1)
        codes = np.stack([nearest(p, c) for p, c in zip(parts, self.codes)], 1).astype(np.uint8)
        far = sum(((p - c[codes[:, i]]) ** 2).sum(1) for i, (p, c) in enumerate(zip(parts, self.codes)))
        return codes, np.sqrt(far)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the other lists within reach."""
        c = self.centres
        gap = np.sqrt(np.maximum(((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T), 0))
        far = (c * c).sum(1) - 2 * x @ c.T
        beyond = far - far[np.arange(len(x)), own][:, None]  # twice the gap times the way to the plane
        return np.nonzero((beyond <= 2 * reach * gap[own] + 1e-9) & (np.arange(len(c)) != own[:, None]))

    def reaches(self, x: np.ndarray, own: int, other: np.ndarray, reach: float) -> np.ndarray:
        """Does each row of ``x``, of list ``own``, search the list beside it?"""
        c, o = self.centres[own], self.centres[other]
        beyond = (o * o).sum(1) - (c * c).sum() - 2 * np.einsum("ij,ij->i", x, o - c)
        return beyond <= 2 * reach * np.sqrt(((o - c) ** 2).sum(1)) + 1e-9

    def table(self, x: np.ndarray, own: int) -> np.ndarray:
        """Squared distances (row, part, code) from the residuals of ``x`` in list ``own``."""
        rest = np.split(x - self.centres[own], PARTS, axis=1)
        return np.stack([(p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * p @ c.T for p, c in zip(rest, self.codes)], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _deal(coder: Coder, width: int, reach: float):
    """Arrow task: (rid, size, copies, values) -> rows of lists (role 0) and of searches (role 1)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, size, copies, values = batch.columns
            n = len(rid)
            x = np.zeros((n, width))
            flat, at = np.asarray(values.flatten()).astype(np.float64), np.asarray(values.offsets) - values.offsets[0].as_py()
            lengths = np.diff(at)
            x[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(at[:-1], lengths)] = flat
            # scaled first, so that squares of tiny or huge components keep their digits
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for i in range(0, n, 512):
                yield dealt(rid.slice(i, 512), size.slice(i, 512), copies.slice(i, 512), x[i:i + 512])

    def dealt(rid, size, copies, x):
        own = nearest(x, coder.centres)
        codes, error = coder.encode(x, own)
        row, lists = coder.probes(x, own, reach)
        every = np.concatenate([np.arange(len(x)), row])
        role = np.repeat([0, 1], [len(x), len(row)])
        raw = [v.tobytes() for v in x]
        return pa.RecordBatch.from_pydict({
            "list": pa.array(np.concatenate([own, lists]).astype(np.int32)), "size": size.take(pa.array(every)),
            "role": pa.array(role.astype(np.int32)), "home": pa.array(own[every].astype(np.int32)),
            "rid": rid.take(pa.array(every)), "copies": copies.take(pa.array(every)),
            "codes": pa.array([codes[i].tobytes() if r == 0 else None for i, r in zip(every, role)], pa.binary()),
            "error": pa.array(np.where(role == 0, error[every], 0.0)), "unit": pa.array([raw[i] for i in every], pa.binary())})

    return task


def _meet(coder: Coder, width: int, cosine: float, radius: float, reach: float):
    """Arrow task: blocks (list, size, block, turn; role, own) sorted by block -> (rid, links, root)."""
    def linked(members, units, codes, error, number, searches):
        """Index pairs (search, member) at the cosine."""
        rid, unit, inside, home = searches
        table = coder.table(unit, number)
        far = np.zeros((len(rid), len(members)))
        for part in range(PARTS):
            far += table[:, part, :][:, codes[:, part]]
        a, b = np.nonzero((np.sqrt(np.maximum(far, 0)) <= radius + error + 1e-9) & (~inside[:, None] | (rid[:, None] > members)))
        close = np.empty(len(a), bool)
        for i in range(0, len(a), 1 << 16):
            close[i:i + (1 << 16)] = np.einsum("ij,ij->i", unit[a[i:i + (1 << 16)]], units[b[i:i + (1 << 16)]]) >= cosine
        a, b = a[close], b[close]
        # a link between lists counts where the list is the larger one, unless only this side finds it
        late = np.flatnonzero(home[a] > number)
        twice = late[coder.reaches(units[b[late]], number, home[a[late]], reach)]
        return np.delete(a, twice), np.delete(b, twice)

    def solve(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        role = np.asarray(t["role"])
        rid, copies = np.asarray(t["rid"]), np.asarray(t["copies"])
        member, search = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(member) or not len(search):
            return None
        units = _matrix(t["unit"], width)
        codes = np.frombuffer(b"".join(t["codes"].take(pa.array(member)).to_pylist()), np.uint8).reshape(-1, PARTS)
        error, own, home = np.asarray(t["error"])[member], np.asarray(t["own"]), np.asarray(t["home"])
        number = t["list"][0].as_py()
        sums: dict[int, int] = {}
        root: dict[int, int] = {}

        def top(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for i in range(0, len(search), 256):
            s = search[i:i + 256]
            a, b = linked(rid[member], units[member], codes, error, number, (rid[s], units[s], own[s], home[s]))
            if not len(a):
                continue
            left, right = s[a], member[b]
            for ids, n in ((left, copies[right]), (right, copies[left])):
                keys, place = np.unique(rid[ids], return_inverse=True)
                for k, v in zip(keys.tolist(), np.bincount(place, weights=n).tolist()):
                    sums[k] = sums.get(k, 0) + int(v)
            # each search joins its least partner, and so all of them
            for u, v in zip(rid[left].tolist(), rid[right].tolist()):
                u, v = top(u), top(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
        if not sums:
            return None
        keys = list(sums)
        return pa.RecordBatch.from_pydict({"rid": pa.array(keys, pa.int64()), "links": pa.array([sums[k] for k in keys], pa.int64()),
                                           "root": pa.array([top(k) for k in keys], pa.int64())})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)) for i in range(4)])
            cuts = [0, *(np.flatnonzero((np.diff(rows) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                now = tuple(rows[:, a])
                if now != key and held:
                    out = solve(held)
                    held = []
                    if out is not None:
                        yield out
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            out = solve(held)
            if out is not None:
                yield out

    return task


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


def cosine_links(vectors: DataFrame, cosine: float = 0.9, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding).

    Without ``deviations`` every list that can hold a partner is searched."""
    spark = vectors.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    values = F.transform("embedding", lambda x: x.cast("double") + 0.0)  # -0.0 becomes 0.0
    rows = vectors.select("vec_id", F.when(F.coalesce(usable(F.col("embedding")), F.lit(False)), values).alias("values"))
    # equal vectors once; ids stay put because the table is written
    units = stage(stage(rows.filter("values is not null").groupBy("values").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first")), "vectors").withColumn(
        "rid", F.monotonically_increasing_id()).withColumn("size", F.size("values")), "vectors")
    count, longest = units.agg(F.count("*"), F.max("size")).first()
    alone = rows.filter("values is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                 F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return alone
    width = -(-longest // PARTS) * PARTS
    sample = units.orderBy(F.xxhash64("rid")).limit(SAMPLE).select("values").toArrow()["values"].to_pylist()
    x = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        x[i, :len(v)] = v
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coder = Coder(x, min(LISTS, max(1, count // PER_LIST)))

    spread = np.linalg.eigvalsh(np.cov(x.T)) if len(x) > 1 else np.zeros(1)
    dimension = max(1.0, spread.sum() ** 2 / max((spread**2).sum(), 1e-300))
    reach = radius if deviations is None else min(radius, deviations * radius / math.sqrt(dimension))

    dealt = stage(units.select("rid", "size", "copies", "values").mapInArrow(
        _deal(coder, width, reach), "list int, size int, role int, home int, rid long, copies long, codes binary, error double, unit binary"), "lists")
    # at most LISTS * lengths * 2 rows
    load = dealt.groupBy("list", "size").agg(F.sum(1 - F.col("role")).alias("m"), F.count("*").alias("s")).select(
        "list", "size", F.ceil(F.greatest("m", F.lit(1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("s") / SEARCHES).cast("int").alias("turns"))
    held = dealt.join(F.broadcast(load), ["list", "size"]).withColumn(
        "own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn(
        "turn", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("turns")).cast("int"))
    place = ["list", "size", "block", "turn", "role"]
    rest = ["home", "rid", "copies", "codes", "error", "unit"]
    members = held.filter("role = 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(
        "list", "size", F.col("own").alias("block"), "turn", "role", F.lit(False).alias("own"), *rest)
    # members search the blocks from their own on, others all blocks
    first = F.when(F.col("role") == 0, F.col("own")).otherwise(0)
    searches = held.withColumn("block", F.explode(F.sequence(first, F.col("blocks") - 1))).select(
        "list", "size", "block", "turn", F.lit(1).alias("role"),
        ((F.col("role") == 0) & (F.col("block") == F.col("own"))).alias("own"), "home", "rid", "copies",
        F.lit(None).cast("binary").alias("codes"), "error", "unit")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = members.select(*place, "own", *rest).union(searches).repartition(n, "list", "size", "block", "turn").sortWithinPartitions(*place)
    found = stage(met.mapInArrow(_meet(coder, width, cosine, radius, reach), "rid long, links long, root long"), "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    stars = components(found.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    member = units.select("rid", "values", "copies", "first").join(links, "rid", "left").join(
        stars.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stage(member.join(least, "component").select(
        "values", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    return rows.filter("values is not null").join(named, "values").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(alone)

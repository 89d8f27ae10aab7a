"""Near-duplicates by SimHash; close fingerprints meet in a self-join of a binary trie.

Defined cases. A null text counts as empty. Texts without words have fingerprint zero and link
like any other. Repeated rows and ties are linked as distance zero. A null doc_id never names a
component; a component of nulls only has a null id. An empty table gives no rows. Other columns
of the input are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .tables import small_batches, with_columns

BITS = 64
SEED = 42
#: fingerprints below one trie node that a task compares with each other
NODE_LIMIT = 512
#: node pairs held at a time while a trie is traversed
FRONT = 200_000


def fingerprint(text: bytes, n: int = 3) -> int:
    """Majority of the bits of the XXH64 of all runs of ``n`` words (of all words if fewer)."""
    words = text.lower().split()  # of bytes: A-Z and the ASCII white space only
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(n))) if len(words) >= n else [tuple(words)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(r), SEED) for r in runs), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``fingerprint`` (the 64 bits as a long)."""
    small_batches(docs.sparkSession)

    def of(column: pa.Array) -> dict[str, pa.Array]:
        prints = (fingerprint(b"" if t is None else t) for t in column.cast(pa.binary()).to_pylist())
        return {"fingerprint": pa.array(np.fromiter(prints, np.uint64, len(column)).view(np.int64))}

    return with_columns(docs, text, of, "fingerprint bigint", keep)


def rotated(h: np.ndarray, by: int) -> np.ndarray:
    return h if by == 0 else (h << np.uint64(by)) | (h >> np.uint64(BITS - by))


def near_pairs(h: np.ndarray, fronts: np.ndarray, bit: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at up to ``budget`` differing bits, from the tries below pairs of nodes.

    A node is a range of ``h``, sorted there, whose values agree above ``bit``. ``fronts`` has a
    row (left begin, end, right begin, end) per pair of nodes; the two are the same or disjoint.
    Pairs of nodes go down one bit at a time, adding the bits in which they differ, and end where
    these exceed the budget. A pair of single values is compared at once."""
    stack = [(bit, fronts, np.zeros(len(fronts), np.int8))]
    while stack:
        bit, front, errors = stack.pop()
        if len(front) > FRONT:
            half = len(front) // 2
            stack += [(bit, front[half:], errors[half:]), (bit, front[:half], errors[:half])]
            continue
        same = front[:, 0] == front[:, 2]
        size = (front[:, 1] - front[:, 0]), (front[:, 3] - front[:, 2])
        done = (size[0] == 1) & (size[1] == 1)
        if bit < 0:  # equal values left and right; values are distinct
            done = ~same
        ends = front[done & ~same]
        if len(ends):
            far = np.bitwise_count(h[ends[:, 0]] ^ h[ends[:, 2]])
            ends = ends[far <= budget]
            yield ends[:, 0], ends[:, 2]
        front, errors, same = front[~done], errors[~done], same[~done]
        if bit < 0 or not len(front):
            continue
        ones = np.concatenate([[0], np.cumsum((h >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        a, b, c, d = front.T
        m, n = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        lower, upper = np.stack([a, m, c, n], 1), np.stack([m, b, n, d], 1)
        cross, back = np.stack([a, m, n, d], 1), np.stack([m, b, c, n], 1)[~same]
        more = errors + 1
        front = np.concatenate([lower, upper, cross, back])
        errors = np.concatenate([errors, errors, more, more[~same]])
        live = (errors <= budget) & (front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3])
        stack.append((bit - 1, front[live], errors[live]))


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of a[i] and b[i]; root[x] <= x leads to the least member."""
    while len(a):
        a, b = root[a], root[b]
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _trie_task(parts: list[tuple[int, int]], budget: int):
    """Arrow task: rows (part, node, i, j, side, fingerprint) sorted by group -> edges (a, b)."""
    def solve(part, group, side, prints):
        """Edges to the least value of each class that is linked within a group."""
        turn = np.array([p[0] for p in parts], np.int64)[part]
        h = prints.copy()
        for by in np.unique(turn):
            h[turn == by] = rotated(prints[turn == by], int(by))
        order = np.lexsort((h, side, group))
        h, group, side, prints, part = h[order], group[order], side[order], prints[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(side) != 0)]))
        last = np.append(first[1:], len(h))
        mates = np.flatnonzero((group[first[1:]] == group[first[:-1]]))
        two = np.stack([first[mates], last[mates], first[mates + 1], last[mates + 1]], 1)
        # a node whose chunks i and j are the same is joined with itself
        alone = np.setdiff1d(np.arange(len(first)), np.concatenate([mates, mates + 1]))
        alone = alone[(last[alone] - first[alone] > 1) & (side[first[alone]] == 0)]
        one = np.stack([first[alone], last[alone], first[alone], last[alone]], 1)
        fronts = np.concatenate([one, two])
        root = np.arange(len(h))
        for p, (_, width) in enumerate(parts):
            own = fronts[part[fronts[:, 0]] == p]
            for a, b in near_pairs(h, own, BITS - 1 - width, budget):
                join_roots(root, a, b)
        linked = np.flatnonzero(root != np.arange(len(h)))
        return pa.RecordBatch.from_pydict({"a": pa.array(prints[linked].view(np.int64)),
                                           "b": pa.array(prints[root[linked]].view(np.int64))})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(6)])
            held.append(rows)
            if sum(r.shape[1] for r in held) < 20_000:
                continue
            rows = np.concatenate(held, axis=1)
            # the last group may go on in the next batch
            moved = np.flatnonzero((np.diff(rows[:4]) != 0).any(axis=0))
            cut = int(moved[-1]) + 1 if len(moved) else 0
            held = [rows[:, cut:]]
            if cut:
                yield solved(rows[:, :cut])
        if held and sum(r.shape[1] for r in held):
            yield solved(np.concatenate(held, axis=1))

    def solved(rows):
        new = np.concatenate([[0], np.cumsum((np.diff(rows[:4]) != 0).any(axis=0))])
        return solve(rows[0], new, rows[4], rows[5].view(np.uint64))

    return task


def trie_links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Edges (a, b) between distinct ``fingerprint`` values that connect all within ``budget`` bits.

    Values at most ``budget`` bits apart agree in one of budget + 1 parts of their bits. So the
    trie is traversed once per part, rotated to begin with it, with a budget of zero down to its
    end and the whole budget below. Down to there only a node and itself can pair, so each node
    is one group of a shuffle. A node with more than NODE_LIMIT values is cut into chunks whose
    pairs are groups of their own. Of the links found in a task only a spanning forest leaves it;
    a value has at most C(64, 1) + C(64, 2) neighbours at two bits, so none needs a cap."""
    cuts = [round(BITS * i / (budget + 1)) for i in range(budget + 2)]
    parts = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(budget + 1)]
    h = F.col("fingerprint")
    nodes = [F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(
        F.shiftleft(h, by) if by else h, BITS - width).alias("node")) for i, (by, width) in enumerate(parts)]
    rows = prints.select("fingerprint", F.explode(F.array(*nodes)).alias("_n")).select("fingerprint", "_n.*")
    crowded = rows.groupBy("part", "node").count().filter(F.col("count") > NODE_LIMIT).select(
        "part", "node", F.ceil(F.col("count") / NODE_LIMIT).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(
        F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"),
        (k < F.col("own")).cast("int").alias("side")))
    dealt = (rows.join(crowded, ["part", "node"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
             .withColumn("own", own).select("part", "node", "fingerprint", F.explode(others).alias("_c"))
             .select("part", "node", "_c.i", "_c.j", "_c.side", "fingerprint"))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "part", "node", "i", "j").sortWithinPartitions("part", "node", "i", "j")
    return dealt.mapInArrow(_trie_task(parts, budget), "a bigint, b bigint")


def simhash_components(docs: DataFrame, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; fingerprint as 16 hexadecimal digits.

    Rows link when their fingerprints differ in at most ``budget`` bits; component_id is the
    smallest doc_id that links lead to, the row's own included."""
    marked = stage(fingerprints(docs, ["doc_id"]), "fingerprints")
    classes = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    stars = components(trie_links(classes.select("fingerprint"), budget))
    # the least value of each component is not a node of its star
    member = classes.join(stars.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stage(member.join(least, "component").select("fingerprint", "component_id"), "components")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, budget: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose doc_id names their component; of
    repeated rows of such an id one stays. Rows without an id stay, as no decision can name them."""
    named = stage(simhash_components(docs, budget).filter("doc_id = component_id").groupBy("doc_id").count(), "kept")
    # the ids grow with the documents, so the join is the same at every size: by hash, unsorted
    kept = docs.join(named.filter("count = 1").hint("shuffle_hash"), "doc_id", "left_semi")
    repeated = named.filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.union(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.union(docs.filter("doc_id is null")).select(docs.columns)

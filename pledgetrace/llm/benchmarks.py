"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by their number of distinct five-word shingles. For each partition a
document is seen as overlapping windows of shingles that are long enough to hold any of its items
whole, so that containment turns into a Jaccard similarity that MinHash can find: a window and an
item that share a MinHash value are candidates. Candidates are verified by exact containment: the
share of the item's shingles, compared word by word, that the whole document has.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

Defined cases. A null text counts as empty. Items of fewer than five words have no shingle and
match nothing; so do documents of fewer. Repeated rows of documents or items give repeated
matches. Null ids are carried along. Empty tables give no rows. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import declared, filtered, small_batches, text_bytes, unused
from .words import NOT_ALNUM, Lookup, shingles, words

WORDS = 5
CONTAINMENT = 0.8
FUNCTIONS = 48
#: shingles per block; windows are whole blocks and begin at every block
BLOCK = 16
#: items of up to so many shingles have windows of one shingle
TINY = 8
#: bytes of item texts that one pass over the documents holds; more items take more passes
PASS_BYTES = 16 << 20


def hash_functions(h: np.ndarray) -> Iterator[np.ndarray]:
    """FUNCTIONS permutations of the upper 32 bits."""
    rng = np.random.default_rng(20)
    low = (h >> np.uint64(32)).astype(np.uint32)
    for a, b in zip(rng.integers(1 << 20, 1 << 31, FUNCTIONS) * 2 + 1, rng.integers(0, 1 << 32, FUNCTIONS)):
        x = low * np.uint32(a & 0xFFFFFFFF)
        x ^= x >> np.uint32(15)
        x += np.uint32(b)
        yield x


def _words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes().lower()
    return [raw[a:b] for a, b in zip(starts, ends)]


def shingle_set(text: bytes) -> set[tuple[bytes, ...]]:
    """Distinct runs of WORDS words."""
    data = np.frombuffer(text, np.uint8)
    _, starts, ends, _ = words(data, np.array([0, len(data)]), NOT_ALNUM)
    w = _words_of(data, starts, ends)
    return set(zip(*(w[i:] for i in range(WORDS))))


class Items:
    """The items of one pass, indexed by MinHash values per size partition."""

    def __init__(self, texts: list[bytes]) -> None:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        first, _, _, h = words(np.frombuffer(b"".join(texts), np.uint8), offsets, NOT_ALNUM)
        sh, bounds = shingles(first, h, WORDS)
        self.texts = texts
        self.hashes = [np.unique(sh[bounds[i]:bounds[i + 1]]) for i in range(len(texts))]
        size = np.array([len(x) for x in self.hashes], np.int64)
        self.tiny = self._tiny(np.flatnonzero((size > 0) & (size <= TINY)))
        self.partitions = []
        top = TINY
        while top < size.max(initial=0):
            low, top = top, top * 2
            own = np.flatnonzero((size > low) & (size <= top))
            if len(own):
                # any run of `top` shingles lies within so many blocks, wherever it begins
                self.partitions.append((-(-(top + BLOCK - 1) // BLOCK), own, self._signatures(own)))

    def _tiny(self, own: np.ndarray) -> tuple[Lookup, np.ndarray, np.ndarray] | None:
        if not len(own):
            return None
        pairs = np.array([(h, i) for i in own for h in self.hashes[i].tolist()], dtype=object)
        keys, place = np.unique(pairs[:, 0].astype(np.uint64), return_inverse=True)
        order = np.argsort(place, kind="stable")
        return (Lookup(keys), np.searchsorted(place[order], np.arange(len(keys) + 1)),
                pairs[order, 1].astype(np.int64))

    def _signatures(self, own: np.ndarray):
        """Per function: (bitmap by the upper 16 bits, sorted values, items in that order)."""
        flat = np.concatenate([self.hashes[i] for i in own])
        at = np.concatenate([[0], np.cumsum([len(self.hashes[i]) for i in own])])[:-1]
        out = []
        for x in hash_functions(flat):
            value = np.minimum.reduceat(x, at)
            order = np.argsort(value, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[value >> np.uint32(16)] = True
            out.append((seen, value[order], own[order]))
        return out


def candidates(sh: np.ndarray, bounds: np.ndarray, items: Items) -> np.ndarray:
    """Distinct rows (text, item) that share a MinHash value in some window."""
    found = [np.zeros((0, 2), np.int64)]
    count = np.diff(bounds)
    if items.tiny:
        lookup, starts, of = items.tiny
        at, place = lookup.hits(sh)
        text = np.searchsorted(bounds, at, "right") - 1
        n = starts[place + 1] - starts[place]
        into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.append(np.stack([np.repeat(text, n), of[np.repeat(starts[place], n) + into]], 1))
    if items.partitions:
        widest = max(w for w, _, _ in items.partitions)
        blocks = -(-count // BLOCK)
        # blank blocks behind each text keep its windows apart from the next
        base = np.concatenate([[0], np.cumsum(blocks + widest - 1)])
        first = np.flatnonzero(count)
        inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        cuts = np.repeat(bounds[:-1], blocks) + inner * BLOCK
        place = np.repeat(base[:-1], blocks) + inner
        text_of = np.zeros(base[-1], np.int64)
        text_of[place] = np.repeat(np.arange(len(count)), blocks)
        for j, x in enumerate(hash_functions(sh)):
            least = np.full(base[-1], 0xFFFFFFFF, np.uint32)
            if len(first):
                least[place] = np.minimum.reduceat(x, cuts)
            window, width = least, 1
            for need, _, signatures in sorted(items.partitions, key=lambda p: p[0]):
                while width < need:  # windows of `need` blocks from shorter ones
                    step = min(width, need - width)
                    window = np.minimum(window[:-step], window[step:])
                    width += step
                seen, values, of = signatures[j]
                at = np.flatnonzero(seen[window >> np.uint32(16)])
                left = np.searchsorted(values, window[at], "left")
                n = np.searchsorted(values, window[at], "right") - left
                at, left, n = at[n > 0], left[n > 0], n[n > 0]
                if len(at):
                    into = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.stack([np.repeat(text_of[at], n), of[np.repeat(left, n) + into]], 1))
    return np.unique(np.concatenate(found), axis=0)


def found_items(data: np.ndarray, offsets: np.ndarray, items: Items, threshold: float) -> list[tuple[int, int, int, int]]:
    """(text, item, shared shingles, shingles of the item) for the items that texts contain."""
    first, _, _, h = words(data, offsets, NOT_ALNUM)
    sh, bounds = shingles(first, h, WORDS)
    rows, exact, last = [], set(), -1
    for text, item in candidates(sh, bounds, items).tolist():
        hashes = items.hashes[item]
        if np.isin(hashes, sh[bounds[text]:bounds[text + 1]]).sum() < threshold * len(hashes):
            continue
        if text != last:
            exact, last = shingle_set(data[offsets[text]:offsets[text + 1]].tobytes()), text
        wanted = shingle_set(items.texts[item])
        shared = len(wanted & exact)
        if shared >= threshold * len(wanted):
            rows.append((text, item, shared, len(wanted)))
    return rows


def _search(items: Items, ids: pa.Array, threshold: float):
    """Arrow task: (key columns…, text) -> (key columns…, item_id, shared, item_shingles)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = found_items(*text_bytes(batch.column(batch.num_columns - 1)), items, threshold)
            text, item, shared, total = list(zip(*rows)) or [()] * 4
            take = pa.array(text, pa.int64())
            out = {batch.schema.names[i]: batch.column(i).take(take) for i in range(batch.num_columns - 1)}
            out["item_id"] = ids.take(pa.array(item, pa.int64()))
            out["shared"], out["item_shingles"] = pa.array(shared, pa.int64()), pa.array(total, pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return task


def contained_items(docs: DataFrame, benchmark: DataFrame, keep: list[str], threshold: float = CONTAINMENT) -> DataFrame:
    """(keep…, item_id, shared, item_shingles, containment) for each item in each document that
    holds at least ``threshold`` of the item's shingles; kept columns of these names give way."""
    small_batches(docs.sparkSession)
    keep = [k for k in keep if k not in ("item_id", "shared", "item_shingles", "containment")]
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = ", ".join([*declared(docs, keep), f"item_id {kind}, shared bigint, item_shingles bigint"])
    out = None
    for items, ids in item_passes(benchmark):
        part = docs.select(*keep, F.col("text").alias(unused(docs, "_text"))).mapInArrow(_search(items, ids, threshold), schema)
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def item_passes(benchmark: DataFrame) -> Iterator[tuple[Items, pa.Array]]:
    """The items in parts of about PASS_BYTES, which is what reaches the driver and each task."""
    n = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = n // PASS_BYTES + 1
    turn = F.pmod(F.xxhash64("text", "item_id"), F.lit(passes))
    for k in range(passes):
        held = benchmark.filter(turn == k).select("item_id", F.coalesce("text", F.lit("")).alias("text")).toArrow()
        yield Items([t.encode() for t in held["text"].to_pylist()]), held["item_id"].combine_chunks()


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item."""
    small_batches(docs.sparkSession)

    def without(items: Items):
        def keep(column: pa.Array) -> np.ndarray:
            out = np.ones(len(column), bool)
            out[[r[0] for r in found_items(*text_bytes(column), items, threshold)]] = False
            return out

        return keep

    for items, _ in item_passes(benchmark):
        docs = filtered(docs, "text", without(items))
    return docs


#: words and shingles as above, in plain SQL
ORACLE = r"""
with w as (
 select 0 as side, doc_id as id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') as w
 from documents
 union all
 select 1, item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '')
 from benchmark),
s as (select distinct side, id, array_to_string(w[i : i + 4], ' ') as s
 from (select side, id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5) as t),
n as (select id, count(*) as n from s where side = 1 group by id)
select d.id as doc_id, b.id as item_id, count(*) as shared, any_value(n.n) as item_shingles,
 count(*) / any_value(n.n)::double as containment
from s as d join s as b on b.side = 1 and d.side = 0 and b.s = d.s join n on n.id = b.id
group by d.id, b.id having count(*) >= 0.8 * any_value(n.n)
"""

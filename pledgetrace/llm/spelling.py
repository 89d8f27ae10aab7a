"""Spelling variant grouping: words one edit apart by Gram matrices of their letter counts.

One inserted, deleted or replaced character leaves one half of a word whole, so words one edit
apart share a half and their lengths are equal or adjacent. A block holds the words of two adjacent
lengths that share a half, at the cut of the shorter length. Within a block the product of the
letter-count matrices gives all squared distances; an edit moves them by two at most, and what is
that near is compared letter by letter. Pairs never become rows: a task returns, for each word of a
block, how many near words it has there and the most frequent of them.

A block of more than ``CROWD`` words is cut by hash into chunks, and each pair of chunks is a cell of
its own, so that a common half is spread over tasks and no task holds a block. Small blocks of the
same length are multiplied together.

Defined cases. Words are compared by code points and are expected once each; null words are left
out. Words without near words stay, with zero and null. Of near words of equal count the first in
code-point order is taken. An empty table gives no rows. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: words of a block that one product takes; larger blocks are cut
CROWD = 2048
#: buckets that letters are counted in; letters of one bucket only bring words nearer
LETTERS = 32
RATIO = 10
#: rows of a product at a time
ROWS = 512


def run_counts(docs: DataFrame, least: int = 7, often: int = 2, salt: int = 31) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, as the contract alters them:
    where ``salt`` divides the checksum of id and run, one character is taken out."""
    pattern = f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("run")).select("id", F.translate(
            "run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    word = F.when(F.col("h") % salt == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)")))
    words = runs.withColumn("h", h).withColumn("at", at).select(word.otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= often) & (F.length("word") >= least))


def _places(words: DataFrame) -> DataFrame:
    """(size, side, half, word, n): the four blocks of each word. ``size`` is the shorter length of
    the block, ``side`` the half that its words share."""
    length = F.length("word")
    blocks = []
    for size in (length, length - 1):
        cut = F.floor(size / 2).cast("int")
        blocks += [F.struct(size.alias("size"), F.lit("head").alias("side"), F.substring("word", F.lit(1), cut).alias("half")),
                   F.struct(size.alias("size"), F.lit("tail").alias("side"),
                            F.right("word", size - cut).alias("half"))]
    return words.select("word", "n", F.explode(F.array(*blocks)).alias("b")).filter("b.size > 0").select("b.*", "word", "n")


def _cells(places: DataFrame, crowd: int) -> DataFrame:
    """Adds the cell (i, j) of a crowded block and ``right``, whether a word is there as one of chunk j."""
    block = ["size", "side", "half"]
    crowded = places.groupBy(*block).count().filter(F.col("count") > crowd).select(
        *block, F.ceil(F.col("count") / crowd).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(
        F.least("own", other).alias("i"), F.greatest("own", other).alias("j"), (F.col("own") > other).alias("right")))
    return (places.join(crowded, block, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
            .withColumn("cell", F.explode(pairs)).select(*block, "cell.*", "word", "n"))


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Characters of each row counted in buckets."""
    out = np.zeros((len(codes), LETTERS), np.float64 if codes.shape[1] > 4096 else np.float32)
    rows = np.arange(len(codes))
    for column in codes.T:
        np.add.at(out, (rows, column % LETTERS), (column > 0).astype(out.dtype))
    return out


def _codes(words: np.ndarray) -> np.ndarray:
    return words.view(np.uint32).reshape(len(words), -1)


def near_pairs(words: np.ndarray, size: int, tail: bool, cell: np.ndarray, right: np.ndarray,
               cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart that share a cell. ``words`` have ``size`` or one more
    characters. In cells that are ``cross`` only words of different chunks meet. With ``tail``,
    longer words that share the head too are left to the other block."""
    codes = _codes(words)
    long = codes[:, size] > 0 if codes.shape[1] > size else np.zeros(len(words), bool)
    short, longer = np.flatnonzero(~long), np.flatnonzero(long)
    counts = letter_counts(codes)
    square = (counts * counts).sum(axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for others in (short, longer):
        for lo in range(0, len(short), ROWS):
            mine = short[lo:lo + ROWS]
            gap = square[mine, None] + square[None, others] - 2 * (counts[mine] @ counts[others].T)
            a, b = np.nonzero(gap < 2.5)
            a, b = mine[a], others[b]
            ok = (cell[a] == cell[b]) & (~cross[a] | (right[a] != right[b]))
            if others is short:
                ok &= a < b
            a, b = a[ok], b[ok]
            for at in range(0, len(a), 1 << 16):
                x, y = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
                left, other = codes[x, :size], codes[y]
                if others is short:
                    near = (left != other[:, :size]).sum(axis=1) == 1
                else:
                    head = np.logical_and.accumulate(left == other[:, :size], axis=1).sum(axis=1)
                    end = np.logical_and.accumulate((left == other[:, 1:size + 1])[:, ::-1], axis=1).sum(axis=1)
                    near = (head + end >= size) & (~np.bool_(tail) | (head < size // 2))
                found.append((x[near], y[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])


def _tile(words: list[str], n: np.ndarray, size: int, tail: bool, cell: np.ndarray, right: np.ndarray,
          cross: np.ndarray) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best) of the words of some cells that have near words there."""
    array = np.array(words, dtype=f"U{size + 1}")
    a, b = near_pairs(array, size, tail, cell, right, cross)
    if not len(a):
        return None
    of, near = np.concatenate([a, b]), np.concatenate([b, a])
    place = np.empty(len(array), np.int64)
    place[np.argsort(array, kind="stable")] = np.arange(len(array))
    order = np.lexsort((place[near], -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    many = np.diff(np.append(first, len(of)))
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[i] for i in of[first]], pa.string()), "n_near": pa.array(many, pa.int64()),
        "best_n": pa.array(n[near[first]], pa.int64()), "best": pa.array([words[i] for i in near[first]], pa.string())})


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells come sorted; whole cells of one length and side are gathered up to CROWD words."""
    held: list[tuple] = []
    cells = 0

    def flush() -> pa.RecordBatch | None:
        size, side = held[0][0][:2]
        ids = np.cumsum(np.array([k[0] != p[0] for p, k in zip(held[:1] + held, held)]))
        return _tile([h[1] for h in held], np.array([h[2] for h in held], np.int64), size, side == "tail", ids,
                     np.array([h[3] for h in held]), np.array([h[0][3] != h[0][4] for h in held]))

    group: list[tuple] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for size, side, half, i, j, right, word, n in zip(*columns):
            key = (size, side, half, i, j)
            if group and group[0][0] != key:
                if held and (held[0][0][:2] != group[0][0][:2] or len(held) + len(group) > CROWD):
                    if (out := flush()) is not None:
                        yield out
                    held = []
                if len(group) > 1:
                    held += group
                group = []
            group.append((key, word, n, right))
    for rest in ([group] if len(group) > 1 else []):
        if held and (held[0][0][:2] != rest[0][0][:2] or len(held) + len(rest) > CROWD):
            if (out := flush()) is not None:
                yield out
            held = []
        held += rest
    if held and (out := flush()) is not None:
        yield out


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, best_n, best): each word with the number of words one edit away and the
    most frequent of them."""
    words = words.select("word", "n").filter("word is not null")
    cells = _cells(_places(words), crowd).select("size", "side", "half", "i", "j", "right", "word", "n")
    key = ["size", "side", "half", "i", "j"]
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.sparkSession.sparkContext.defaultParallelism)
    found = cells.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(
        _multiply, "word string, n_near bigint, best_n bigint, best string")
    each = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"),
                        F.lit(None).cast("string").alias("best"))
    better = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return each.unionByName(found.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), better.alias("b")).select(
        "word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) of the words that have a form. A form is ``ratio`` times as frequent, so a path
    has as many steps as the largest count has factors of it; each round doubles the steps."""
    steps, doubled = 0, 1
    while most >= ratio:
        most, steps = most // ratio, steps + 1
    reach = forms.select("word", F.col("form").alias("root"))
    while doubled < steps:
        reach = stage(reach, "roots")
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reach = reach.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        doubled *= 2
    return reach


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, form, form_n, root). The form of a word is the most frequent word one edit
    away, if that is ``ratio`` times as frequent; the root is where the forms lead."""
    words = stage(words, "words")
    usual = F.col("best_n") >= ratio * F.col("n")
    near = stage(near_words(words, crowd).select(
        "word", "n", "n_near", F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")), "near")
    most = near.agg(F.max("form_n")).first()[0] or 0
    roots = _roots(near.filter("form is not null"), most, ratio)
    return near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = r"""with recursive r as (select coalesce(cast(doc_id as varchar), '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
k as (select id, run, count(*) as m from r where length(run) >= 7 group by all),
b as (select id, run, m, hex(encode(id || ':' || run)) as x from k),
h as (select run, m, xor(list_reduce(list_transform(range(0, 4 * length(x)), lambda i: case when i % 8 = 0 then cast('0x' || substr(x, cast(i // 4 + 1 as bigint), 2) as bigint) else 0 end),
  lambda c, e: case when xor(c, e) & 1 = 1 then xor(xor(c, e) >> 1, 3988292384) else xor(c, e) >> 1 end, 4294967295), 4294967295) as h from b),
w as (select case when h % 31 = 0 then left(run, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, m from h),
words as materialized (select word, cast(sum(m) as bigint) as n from w group by word having sum(m) >= 2 and length(word) >= 7),
gone as materialized (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words)),
pairs as materialized (select distinct a.word as word, b.word as near, b.n as near_n from gone a join gone b on a.i = b.i and a.rest = b.rest where length(a.word) = length(b.word) and a.word <> b.word
  union select distinct a.word, b.word, b.n from gone a join words b on a.rest = b.word union select distinct b.word, a.word, a.n from gone a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(near_n) as best_n, min(near) filter (near_n = top) as best from (select *, max(near_n) over (partition by word) as top from pairs) group by word),
form as materialized (select words.word, n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * n then best end as form, case when best_n >= 10 * n then best_n end as form_n from words left join best using (word)),
chain as (select word, word as root from form union all select c.word, f.form from chain c join form f on f.word = c.root where f.form is not null),
roots as (select word, arg_max(root, n) as root from chain join (select word as root, n from words) using (root) group by word)
select word, n, n_near, form, form_n, root from form join roots using (word)"""

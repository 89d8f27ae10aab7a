"""Dense, lexical and fused ranking of all passages for all queries at once.

Scoring every passage against every query cannot be avoided for an exact ranking, but writing
those pairs down can: each task scores its own passages against the queries of a pass and keeps
only the best few per query. What is shuffled is ``tasks x queries x pool`` small rows, never
passages and never pairs. A pass has at most ``QUERY_PASS`` queries, which are the only thing sent
to every task. More queries run in several passes over passages that were chunked, split into
terms and embedded once; each pass is written before the next one begins.

Which pages a query may see is a relation of two tables over groups. It reaches the task as a
bitmap per page, one bit per query of the pass, and masks the scores there; pages that no query
may see are never scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _col, terms, words
from ..functions.tokens import HashedVectors, TopRows
from ..session import spread, stage
from .order import numbered
from .scoring import SCORE_DIGITS, Buckets, Postings, blocks, lay_out, unit_rows, unpacked

QUERY_PASS = 4096
#: passages scored at a time
SLICE = 512
RRF_CONSTANT = 60
FLOOR = 1e-9


def pool_size(k: int) -> int:
    """How many rows each ranking contributes before fusion."""
    return max(4 * k, 20)


def hashing_embed(df: DataFrame, key: str, text: str) -> DataFrame:
    """R1 as a sparse table (key, dim, weight). A text's words are counted in its row, so only the few
    keys that have more than one row are grouped."""
    split = F.array_join(words(F.lower(F.col(text))), " ")
    texts = spread(df.select(key, text)).select(key, split.alias("_words")).filter("_words <> ''")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HashedVectors()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                rows, dims, weights = model.sparse(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(dims, pa.int32()), pa.array(weights, pa.float64())],
                    [key, "dim", "weight"])

    rows = texts.mapInArrow(counted, T.StructType([df.schema[key], *T.StructType.fromDDL("dim int, weight double").fields]))
    many = df.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_key"), F.lit(True).alias("_many"))
    if many.isEmpty():
        return rows
    marked = rows.join(stage(many, "many"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    again = marked.filter("_many").groupBy(key, "dim").agg(F.sum("weight").alias("weight"))
    return marked.filter("_many is null").drop("_many").unionByName(again)


def embed(text: Column | str, provider: Callable[[], Callable] = HashedVectors) -> Column:
    """a dense vector column. ``provider()`` is called once per task and must return, for
    a list of texts, as many vectors in the same order."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for batch in batches:
            vectors = np.asarray(model(list(batch)), dtype="float32")
            if len(vectors) != len(batch):
                raise ValueError(f"sent {len(batch)} texts, got {len(vectors)} vectors")
            yield pd.Series(list(vectors), index=batch.index)
    return run(_col(text))


# -- queries in bounded passes ---------------------------------------------------------------

class Eligible(NamedTuple):
    """Which pages a query may see: those that share a group with it. ``queries(query_id, group)``
    and ``pages(group, page_id)``; a table of single pairs is one whose groups are its pages."""

    queries: DataFrame
    pages: DataFrame


def seen_by_any(pages: DataFrame, eligible: Eligible, page: str = "page_id") -> DataFrame:
    """The pages that some query may see."""
    groups = eligible.queries.select("group").distinct()
    return pages.join(eligible.pages.join(groups, "group", "left_semi").select(page).distinct(), page, "left_semi")


def page_masks(asked: list, eligible: Eligible, query: T.StructField, query_key: str, page: str) -> DataFrame:
    """(page, _mask): a bit per query of a pass that may see the page."""
    spark = eligible.pages.sparkSession
    place = T.StructType([T.StructField(query_key, query.dataType), T.StructField("_i", T.LongType())])
    # as many rows as a pass has queries
    index = F.broadcast(spark.createDataFrame([(q, i) for i, q in enumerate(asked)], place))
    size = -(-len(asked) // 8)
    groups = eligible.queries.join(index, query_key).groupBy("group").agg(
        F.substring(F.bitmap_construct_agg("_i"), 1, size).alias("_bits"))
    whole = eligible.pages.select("group", page).join(groups, "group").groupBy(page).agg(
        F.bitmap_or_agg("_bits").alias("_mask"))
    return whole.select(page, F.substring("_mask", 1, size).alias("_mask"))


def _term_ids(text: str) -> Column:
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut into a few passages, so that what a task holds of scores does not follow the batch."""
    for frame in batches:
        for lo in range(0, len(frame), SLICE):
            yield frame.iloc[lo:lo + SLICE]


def _passes(queries: DataFrame, key: str) -> Iterator[tuple[pd.DataFrame, bool]]:
    """(queries of a pass, whether it is the only one)."""
    first = queries.limit(QUERY_PASS + 1).toPandas()
    if len(first) <= QUERY_PASS:
        yield first, True
        return
    queries = stage(queries, "queries")
    count = -(-queries.count() * 5 // (QUERY_PASS * 4))
    for p in range(count):
        yield queries.filter(F.pmod(F.xxhash64(key), F.lit(count)) == p).toPandas(), False


class _Scan:
    """Queries and passages made ready, and a way to run a task over all passages for each pass."""

    def __init__(self, queries: DataFrame, passages: DataFrame, keys: list[str], query_key: str, vector: str | None,
                 text: str | None, provider: Callable | None, lexical: bool, eligible: Eligible | None, page: str,
                 again: bool = False) -> None:
        self.keys, self.query_key, self.provider, self.lexical = keys, query_key, provider, lexical
        self.eligible, self.page, self.query = eligible, page, queries.schema[query_key]
        stored = vector is not None and vector in queries.columns
        cols = [query_key] + ([F.col(vector).alias("_vector")] if stored else []) + (
            [F.col(text).alias("_text")] if provider is not None and not stored else [])
        asked = queries.select(*cols, *([F.array_distinct(_term_ids(text)).alias("_terms")] if lexical else []))
        stored = vector is not None and vector in passages.columns
        cols = list(dict.fromkeys(keys + ([page] if eligible else [])))
        cols += [F.col(vector).alias("_vector")] if stored else [F.col(text).alias("_text")] if provider is not None else []
        if lexical:
            cols.append(_term_ids(text).alias("_terms"))
        self.source, self.again = spread(passages.select(*cols)), again
        self.frames = _passes(asked, query_key)

    def _ready(self) -> None:
        """For more than one scan, passages are embedded and split once."""
        if self.again is None:
            return
        if "_text" in self.source.columns:
            self.source = self.source.withColumn("_vector", embed("_text", self.provider)).drop("_text")
        self.source, self.again = stage(self.source, "passages"), None

    def passes(self) -> Iterator[tuple[dict, DataFrame, bool]]:
        """(plain arrays of the queries, passages to scan, whether this is the only pass)."""
        for pdf, only in self.frames:
            if self.again or not only:
                self._ready()
            pdf = pdf.sort_values(self.query_key).reset_index(drop=True)
            vectors = None
            if self.provider is not None and len(pdf):
                vectors = list(pdf["_vector"]) if "_vector" in pdf else list(self.provider()(list(pdf["_text"].fillna(""))))
            data = lay_out(pdf, self.query_key, vectors, "_terms" if self.lexical else None)
            rows = self.source
            if self.eligible is not None:
                # written, so that its size is known and passages are never the side that is sent around
                masks = stage(page_masks(data["ids"], self.eligible, self.query, self.query_key, self.page), "masks")
                rows = rows.join(masks, self.page)
            yield data, rows, only

    def reader(self) -> Callable:
        """frame -> (vectors of length one, inverted index, mask), each None if not asked for."""
        provider, lexical = self.provider, self.lexical

        def start() -> Callable:
            model: list = []

            def read(frame: pd.DataFrame, data: dict):
                unit = postings = None
                if provider is not None:
                    if "_vector" in frame:
                        vectors = list(frame["_vector"])
                    else:
                        model[:] = model or [provider()]
                        vectors = list(model[0](list(frame["_text"].fillna(""))))
                    unit = unit_rows(vectors)[0]
                if lexical:
                    postings = Postings(list(frame["_terms"]), data["vocabulary"])
                mask = unpacked(list(frame["_mask"]), len(data["ids"])) if "_mask" in frame else None
                return unit, postings, mask
            return read
        return start

    def schema(self, passages: DataFrame, tail: str) -> T.StructType:
        return T.StructType([self.query, *[passages.schema[k] for k in self.keys], *T.StructType.fromDDL(tail).fields])


def candidates(queries: DataFrame, passages: DataFrame, keys: list[str], *, pool: int,
               query_key: str = "query_id", vector: str | None = None,
               text: str | None = None, provider=HashedVectors, dense: bool = True,
               lexical: bool = True, need_all: bool = False, eligible: Eligible | None = None,
               page: str = "page_id", buckets: Buckets | None = None) -> DataFrame:
    """Per task and query the best ``pool`` rows of each signal:
    (query, keys, signal, similarity, hits); hits are those of the lexical rows.

    ``vector``/``text`` name the columns in both tables. Passages without a stored vector are
    embedded on the way from their text. With ``buckets`` the dense signal looks only at passages
    that share a random-projection bucket with the query."""
    with_vectors = dense or vector is not None
    scan = _Scan(queries, passages, keys, query_key, vector, text, provider if with_vectors else None, lexical,
                 eligible, page)
    schema = scan.schema(passages, "signal string, similarity double, hits bigint")
    out = None
    for data, rows, only in scan.passes():
        shared, start = rows.sparkSession.sparkContext.broadcast(data), scan.reader()

        def run(batches, shared=shared, start=start):
            data, read = shared.value, start()
            parts = blocks(data)
            best = [{s: TopRows(pool, keys, len(b.ids)) for s in ("dense", "lexical")} for b in parts]
            for frame in _slices(batches):
                unit, postings, mask = read(frame, data)
                for block, top in zip(parts, best):
                    asked = np.broadcast_to(block.live, (len(frame), len(block.ids)))
                    if mask is not None:
                        asked = asked & mask[:, block.lo:block.hi]
                    sim = block.similarity(unit) if unit is not None else np.zeros(asked.shape)
                    if dense:
                        near = sim if buckets is None else block.near(unit, buckets)
                        top["dense"].add(frame[keys], near, asked & (near > -np.inf), similarity=sim, hits=np.zeros(asked.shape))
                    if lexical:
                        hit = block.hits(postings, top["lexical"].floor, need_all)
                        top["lexical"].add(frame[keys], hit, asked & (hit > 0), similarity=sim, hits=hit)
            for block, top in zip(parts, best):
                for signal, rows_of in top.items():
                    rows = rows_of.rows()
                    if rows is not None:
                        rows[query_key] = [block.ids[q] for q in rows["_query"]]
                        rows["signal"] = signal
                        rows["hits"] = rows["hits"].astype("int64")
                        yield rows[[query_key, *keys, "signal", "similarity", "hits"]]

        part = rows.mapInPandas(run, schema)
        part = part if only else stage(part, "pass")
        out = part if out is None else out.unionByName(part)
    return out


# -- rankings --------------------------------------------------------------------------------

def top_per(df: DataFrame, group: list[str], order: list[Column], k: int,
            out: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1. Spark cuts each map
    partition to k rows per group before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def match_dense(queries: DataFrame, passages: DataFrame, keys: list[str], k: int, *,
                query_key: str = "query_id", vector: str | None = "vector",
                text: str | None = None, provider=HashedVectors, eligible: Eligible | None = None,
                page: str = "page_id", buckets: Buckets | None = None) -> DataFrame:
    """Nearest passages by cosine, exact; with ``buckets`` among those that share a bucket."""
    best = candidates(queries, passages, keys, pool=k, query_key=query_key, vector=vector, text=text,
                      provider=provider, lexical=False, eligible=eligible, page=page, buckets=buckets)
    return top_per(best, [query_key], [F.desc("similarity"), *keys], k).select(
        query_key, *keys, "similarity", "rank")


def match_lexical(queries: DataFrame, passages: DataFrame, keys: list[str], k: int, *,
                  query_key: str = "query_id", text: str = "text",
                  need_all: bool = False, eligible: Eligible | None = None,
                  page: str = "page_id") -> DataFrame:
    """R4 (any term counts) and R5 (``need_all``): most term hits first."""
    best = candidates(queries, passages, keys, pool=k, query_key=query_key, text=text,
                      dense=False, need_all=need_all, eligible=eligible, page=page)
    return top_per(best, [query_key], [F.desc("hits"), *keys], k).select(
        query_key, *keys, "hits", "rank")


def first_ranks(rankings: DataFrame, query: str, system: str, doc: str, score: str,
                depth: int | None = None) -> DataFrame:
    """Rank per (query, system) from 1; a document listed twice keeps its first rank. With
    ``depth`` only that many places are looked at, and cut before the shuffle; whole rankings
    are numbered range by range."""
    order = [F.desc(score), F.col(doc)]
    ranked = (top_per(rankings, [query, system], order, depth) if depth
              else numbered(rankings, [query, system], order, "rank"))
    return ranked.groupBy(query, system, doc).agg(F.min("rank").alias("rank"))


def fuse_rrf(ranked: DataFrame, keys: list[str], constant: int = RRF_CONSTANT,
             rank: str = "rank") -> DataFrame:
    """Sum of 1 / (constant + rank) over the rankings a row is in."""
    if constant < 1:
        raise ValueError("RRF constant must be positive")
    return ranked.groupBy(*keys).agg(
        F.sum(F.lit(1.0) / (F.lit(constant) + F.col(rank))).alias("fused"))


def match_hybrid(queries: DataFrame, passages: DataFrame, keys: list[str], k: int, *,
                 query_key: str = "query_id", vector: str | None = None, text: str = "text",
                 provider=HashedVectors, eligible: Eligible | None = None,
                 page: str = "page_id") -> DataFrame:
    """Both rankings cut to the pool, fused by reciprocal rank, best k. The similarity
    returned is the dense one. A query without any token finds nothing, and pages that it may not
    see are in neither ranking."""
    pool = pool_size(k)
    best = candidates(queries, passages, keys, pool=pool, query_key=query_key, vector=vector,
                      text=text, provider=provider, eligible=eligible, page=page)
    score = F.when(F.col("signal") == "dense", F.col("similarity")).otherwise(F.col("hits"))
    ranked = top_per(best, [query_key, "signal"], [score.desc(), *keys], pool)
    fused = ranked.groupBy(query_key, *keys).agg(
        F.sum(F.lit(1.0) / (F.lit(RRF_CONSTANT) + F.col("rank"))).alias("fused"),
        F.max("similarity").alias("similarity"), F.max("hits").alias("hits"))
    return top_per(fused, [query_key], [F.desc("fused"), *keys], k)


def fuse_minmax(queries: DataFrame, passages: DataFrame, keys: list[str], k: int, *,
                weight: float = 0.5, query_key: str = "query_id", vector: str | None = None,
                text: str = "text", provider=HashedVectors) -> DataFrame:
    """Weighted sum of both scores, each scaled to 0..1 over all passages.

    First scan: per task and query the four bounds. Second scan: with the bounds known, each task
    can score and cut its passages on its own. Both read passages that were split and embedded once."""
    scan = _Scan(queries, passages, keys, query_key, vector, text, provider, True, None, "", again=True)
    found = T.StructType(T.StructType.fromDDL("_q bigint, dmin double, dmax double, lmin double, lmax double").fields)
    schema = scan.schema(passages, "fused double")
    out = None
    for data, rows, only in scan.passes():
        shared, start = rows.sparkSession.sparkContext.broadcast(data), scan.reader()

        def scored(frame, data, read, parts):
            unit, postings, _ = read(frame, data)
            for block in parts:
                yield block, block.similarity(unit), block.hits(postings)

        def bounds_of(batches, shared=shared, start=start):
            data, read = shared.value, start()
            parts, edge = blocks(data), np.full((4, len(data["ids"])), np.inf)
            for frame in _slices(batches):
                for block, sim, hit in scored(frame, data, read, parts):
                    both = np.stack([sim.min(axis=0), -sim.max(axis=0), hit.min(axis=0), -hit.max(axis=0)])
                    edge[:, block.lo:block.hi] = np.minimum(edge[:, block.lo:block.hi], both)
            at = np.flatnonzero(np.isfinite(edge[0]))
            yield pd.DataFrame({"_q": at, "dmin": edge[0, at], "dmax": -edge[1, at], "lmin": edge[2, at], "lmax": -edge[3, at]})

        # one row per query of the pass
        b = (rows.mapInPandas(bounds_of, found).groupBy("_q")
             .agg(F.min("dmin").alias("dmin"), F.max("dmax").alias("dmax"), F.min("lmin").alias("lmin"),
                  F.max("lmax").alias("lmax")).toPandas().set_index("_q").reindex(range(len(data["ids"]))))
        bounds = rows.sparkSession.sparkContext.broadcast({c: b[c].to_numpy() for c in b})

        def fused(batches, shared=shared, start=start, bounds=bounds):
            data, read, b = shared.value, start(), bounds.value
            parts = blocks(data)
            best = [TopRows(k, keys, len(p.ids)) for p in parts]
            for frame in _slices(batches):
                for (block, sim, hit), top in zip(scored(frame, data, read, parts), best):
                    of = slice(block.lo, block.hi)
                    span_d = np.maximum(b["dmax"][of] - b["dmin"][of], FLOOR)
                    span_l = np.maximum(b["lmax"][of] - b["lmin"][of], FLOOR)
                    top.add(frame[keys], np.round(weight * (hit - b["lmin"][of]) / span_l
                                                  + (1 - weight) * (sim - b["dmin"][of]) / span_d, SCORE_DIGITS))
            for block, top in zip(parts, best):
                rows = top.rows()
                if rows is not None:
                    rows[query_key] = [block.ids[q] for q in rows["_query"]]
                    yield rows[[query_key, *keys, "_score"]].rename(columns={"_score": "fused"})

        part = rows.mapInPandas(fused, schema)
        part = part if only else stage(part, "pass")
        out = part if out is None else out.unionByName(part)
    return top_per(out, [query_key], [F.desc("fused"), *keys], k)


def rerank(ranked: DataFrame, k: int, group: list[str], rank: str = "rank",
           score: str = "rerank_score") -> DataFrame:
    """The first k rows reordered by score, stable; the rest keep their places. A group
    with a missing score in its head keeps the retrieval order and says so in ``rerank_failed``."""
    whole = Window.partitionBy(*group)
    head = F.col(rank) <= k
    failed = F.sum(F.when(head & F.col(score).isNull(), 1).otherwise(0)).over(whole) > 0
    ranked = ranked.withColumn("rerank_failed", failed)
    by = F.when(head & ~F.col("rerank_failed"), F.col(score))
    w = Window.partitionBy(*group).orderBy(
        F.when(head, 0).otherwise(1), by.desc_nulls_last(), F.col(rank))
    return ranked.withColumn("reranked", F.row_number().over(w))


def rerank_scores(query: Column | str, passage: Column | str, scorer: Callable[[], Callable],
                  batch: int = 2, strict: bool = True) -> Column:
    """F2: one finite score per (query, passage), asked for in bounded batches. Without ``strict``
    the pairs of a batch that fails, or whose answer is of no use, are asked for one by one, and
    those that fail again get null: one query's trouble is not another's."""
    def asked(model, queries: list, passages: list) -> list[float]:
        scores = [float(s) for s in model(queries, passages)]
        if len(scores) != len(queries):
            raise ValueError("reranker returned a wrong number of scores")
        if not np.isfinite(scores).all():
            raise ValueError("reranker returned nonfinite scores")
        return scores

    def alone(model, query: str, passage: str) -> float | None:
        try:
            return asked(model or scorer(), [query], [passage])[0]
        except Exception:
            return None

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for queries, passages in batches:
            scores: list[float | None] = []
            for lo in range(0, len(queries), batch):
                part = list(queries[lo:lo + batch]), list(passages[lo:lo + batch])
                try:
                    model = model or scorer()
                    scores += asked(model, *part)
                except Exception:
                    if strict:
                        raise
                    scores += [alone(model, *pair) for pair in zip(*part)]
            yield pd.Series(scores, index=queries.index, dtype="float64")
    return run(_col(query), _col(passage))


def same_document_title(a: Column, b: Column) -> Column:
    """J15 predicate: same digit words and at least four fifths of all words shared."""
    digits = lambda t: F.array_sort(F.filter(t, lambda w: w.rlike(r"\A\p{Nd}+\z")))
    return ((F.size(a) > 0) & (F.size(b) > 0) & (digits(a) == digits(b))
            & (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= 0.8))


def best_per_document(ranked: DataFrame, query_key: str, page: str, title_words: Column,
                      rank: str = "rank") -> DataFrame:
    """Walking down each query's short list, keep a page once, skip copies of a kept
    text and other titles of a kept document.

    The list is one retrieval result (20 rows by default), so the fold sees a bounded group."""
    item = F.struct(F.col(rank).alias("r"), F.col(page).alias("p"), F.col("text_key").alias("t"),
                    title_words.alias("w"))
    rows = F.array_sort(F.collect_list(item))
    clash = lambda kept, x: F.exists(kept, lambda y: (y["p"] == x["p"]) | (y["t"] == x["t"])
                                     | same_document_title(x["w"], y["w"]))
    folded = ranked.groupBy(query_key).agg(rows.alias("_rows"))
    empty = F.slice(F.col("_rows"), 1, 0)
    kept = F.aggregate("_rows", empty, lambda kept, x: F.when(clash(kept, x), kept).otherwise(
        F.array_append(kept, x)))
    picked = folded.select(query_key, F.posexplode(F.transform(kept, lambda x: x["r"]))
                           .alias("_pos", rank))
    return (ranked.join(picked, [query_key, rank])
            .withColumn("doc_rank", F.col("_pos") + 1).drop("_pos"))


def missing_vectors(pages: DataFrame, stored: DataFrame, key: Column) -> DataFrame:
    """Pages whose content key has no stored vectors: model, size or text is new."""
    return pages.withColumn("embed_model", key).join(
        stored.select("page_id", "embed_model").distinct(), ["page_id", "embed_model"],
        "left_anti")

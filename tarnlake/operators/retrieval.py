"""Retrieval: BM25, dense vectors, fusion by reciprocal ranks, filters (RT-01 to RT-05, RT-09, RT-19, RT-20, FL-01 to FL-03).

Every list is a table with ``query_id`` and a dense ``rank`` from 1; orders end in ``chunk_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.config import BROADCAST_BYTES, BROADCAST_ROWS
from tarnlake.functions.text import blank_to_null, tokens
from tarnlake.operators.inverted import K1, B, Index, build_index, open_index, search
from tarnlake.storage import stored

__all__ = ["B", "Index", "K1", "build_index", "open_index", "search"]


def small(df: DataFrame, most: int = BROADCAST_ROWS, width: int | None = None) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``most`` rows, and at most ``BROADCAST_BYTES`` where a row's ``width`` is given."""
    if width is not None:
        most = min(most, BROADCAST_BYTES // max(width, 1))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """SL-02: best ``k`` per query, ties by chunk id. Plans as a group limit before the shuffle and after it."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, dl``: which chunk holds a term how often, and how long it is."""
    split = chunks.select("chunk_id", tokens(F.col("text")).alias("ts"))
    return split.select("chunk_id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in tokens."""
    return chunks.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RT-02 without a stored index: Okapi BM25 over distinct query terms; statistics cover all of ``chunks``.

    Only postings of query terms leave the scan.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    terms = small(asked.select("term").distinct(), width=48)
    found = postings(chunks).join(terms, "term", "left_semi")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(df, "term").crossJoin(F.broadcast(corpus_stats(chunks))).withColumn("part", idf * weight).join(small(asked, width=64), "term")
    return top_k(scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Scores of queries and vectors that are held at a time, and vectors of one block where queries are too many to send.
SCORES = 1 << 21
VECTOR_BLOCK = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best_of(ids: pa.Array, vectors: np.ndarray, asked: np.ndarray, qids: np.ndarray, k: int) -> Iterator[pa.Table]:
    """The ``k`` best of some vectors for each query, ties by id, some queries at a time."""
    order = pc.sort_indices(ids)
    ids, vectors = ids.take(order), vectors[order.to_numpy()].T
    n = len(ids)
    step = max(1, SCORES // n)
    for a in range(0, len(qids), step):
        s = np.round(asked[a : a + step] @ vectors, 6)
        if n > k:
            least = np.partition(s, n - k, axis=1)[:, n - k, None]
            above = s > least
            last = s == least
            keep = above | (last & (np.cumsum(last, axis=1, dtype=np.int32) <= k - above.sum(axis=1)[:, None]))
        else:
            keep = np.ones(s.shape, bool)
        q, v = np.nonzero(keep)
        yield pa.table({"query_id": pa.array(qids[a : a + step][q]), "chunk_id": ids.take(pa.array(v)), "score": pa.array(s[q, v])})


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RT-01: exact search by inner product, as products of matrices over batches.

    Queries of at most ``BROADCAST_BYTES`` go to the vectors, which are read where they lie; more are dealt into blocks that
    each meet every block of vectors. Vectors and queries are of one length.
    """
    found = vectors.select("chunk_id", "embedding").filter("embedding IS NOT NULL")
    asked = queries.select("query_id", "qvec").filter("qvec IS NOT NULL")
    kinds = dict(found.dtypes) | dict(asked.dtypes)
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    width = found.select(F.size("embedding")).first()
    most = BROADCAST_BYTES // (8 * (width[0] if width else 1) + 16)
    if asked.limit(most + 1).count() <= most:
        held = asked.toArrow().combine_chunks()
        if not held.num_rows:
            return top_k(found.limit(0).select(F.lit(None).cast(kinds["query_id"]).alias("query_id"), "chunk_id", F.lit(0.0).alias("score")), k)
        sent = queries.sparkSession.sparkContext.broadcast((_matrix(held.column("qvec").combine_chunks()), held.column("query_id").to_numpy()))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, qids = sent.value
            for b in batches:
                if b.num_rows:
                    for best in _best_of(b.column(0), _matrix(b.column(1)), q, qids, k):
                        yield from best.cast(target).to_batches()

        target = pa.schema([("query_id", held.schema.field("query_id").type), ("chunk_id", pa.string() if kinds["chunk_id"] == "string" else pa.int64()), ("score", pa.float64())])
        return top_k(found.mapInArrow(near, schema), k)
    i = max(1, -(-found.count() // VECTOR_BLOCK))
    j = max(1, -(-asked.count() // most))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = found.withColumn("i", F.pmod(F.xxhash64("chunk_id"), F.lit(i)).cast("int")).withColumn("j", every(j))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(j)).cast("int")).withColumn("i", every(i))

    def pair(v: pa.Table, q: pa.Table) -> pa.Table:
        if v.num_rows and q.num_rows:
            return pa.concat_tables(_best_of(v.column("chunk_id").combine_chunks(), _matrix(v.column("embedding").combine_chunks()), _matrix(q.column("qvec").combine_chunks()), q.column("query_id").to_numpy(), k))
        return pa.table({"query_id": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})

    return top_k(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(pair, schema), k)


def pool_size(top_k: Column, candidate_k: Column, multiplier: int = 3) -> Column:
    """RT-05 for settings in columns: struct ``pool, source`` as :meth:`tarnlake.config.RetrievalConfig.pool` gives."""
    told = F.struct(F.greatest(candidate_k, top_k).alias("pool"), F.lit("explicit").alias("source"))
    return F.when(candidate_k.isNotNull(), told).otherwise(F.struct(F.greatest(top_k * multiplier, top_k).alias("pool"), F.lit("multiplier").alias("source")))


def rrf(arms: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """RT-03: sum of 1 / (constant + rank) over ranked arms, by union and grouping."""
    parts = [a.select("query_id", "chunk_id", (1.0 / (constant + F.col("rank"))).alias("part")) for a in arms]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top_k(every.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def hybrid(chunks: DataFrame | Index, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RT-03: both arms fetch 2k."""
    return rrf([dense(vectors, queries, 2 * k), lexical(chunks, queries, 2 * k)], k)


def lexical(chunks: DataFrame | Index, queries: DataFrame, k: int) -> DataFrame:
    """RT-02 over a stored index or over chunks themselves."""
    return search(chunks, queries, k) if isinstance(chunks, Index) else bm25(chunks, queries, k)


def retrieve(mode: str, chunks: DataFrame | Index | None, vectors: DataFrame | None, queries: DataFrame, k: int, fall_back: bool = True) -> DataFrame:
    """RT-04: dispatch by mode; ``retrieval_mode`` and ``retrieval_error`` say what was done.

    Each arm runs on its own and its list is written, so an arm that cannot be planned or whose job fails (a lost file, a model
    that raises) is known before anything is fused. ``hybrid`` whose lexical arm fails falls back to dense search alone and keeps the reason, as
    does a hybrid without vectors to lexical search. What fails as well is told by :func:`failed`. Who doesn't read ``retrieval_mode`` asks with
    ``fall_back`` false: an arm that fails then ends the call.
    """
    if mode not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"no such retrieval mode: {mode}")
    named = lambda df, how, why=None: df.withColumn("retrieval_mode", F.lit(how)).withColumn("retrieval_error", F.lit(why).cast("string"))
    spark = queries.sparkSession
    try:
        if mode == "bm25":
            return named(stored(spark, lexical(chunks, queries, k), "arm"), "bm25")
        if mode == "dense":
            return named(stored(spark, dense(vectors, queries, k), "arm"), "dense")
    except Exception as e:  # noqa: BLE001  an arm that cannot run is a result, not a crash
        if not fall_back:
            raise
        return failed(queries, mode, e)
    arms, why = {}, []
    for name, arm in (("dense", lambda n: dense(vectors, queries, n)), ("bm25", lambda n: lexical(chunks, queries, n))):
        try:
            arms[name] = stored(spark, arm(2 * k), "arm")
        except Exception as e:  # noqa: BLE001
            if not fall_back:
                raise
            why.append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
    if len(arms) == 2:
        return named(rrf([arms["dense"], arms["bm25"]], k), "hybrid")
    if not arms:
        return failed(queries, mode, "; ".join(why))
    (name, found), = arms.items()
    return named(found.filter(F.col("rank") <= k), f"{name}_fallback", why[0])


def failed(queries: DataFrame, mode: str, error: Exception | str) -> DataFrame:
    """RT-04: no candidates for any query, with the reason in one row per query (rank and chunk null)."""
    told = error if isinstance(error, str) else f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"
    return queries.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), F.lit("failed").alias("retrieval_mode"), F.lit(f"{mode}: {told}").alias("retrieval_error"))


def leaves(chunks: DataFrame, level: int = 3) -> DataFrame:
    """FL-01."""
    return chunks.filter(F.col("chunk_level") == level)


def allowed_files(chunks: DataFrame, names: list[str]) -> DataFrame:
    """FL-02: keep the named files; names are trimmed, blank ones dropped, and without any there is no filter."""
    held = list(dict.fromkeys(n.strip() for n in names if n and n.strip()))
    return chunks.filter(F.col("filename").isin(held)) if held else chunks


def effective_score() -> Column:
    return F.coalesce("rerank_score", "score")


def by_score(candidates: DataFrame) -> DataFrame:
    """RT-09: stable sort by effective score, no score counting as 0."""
    by = Window.partitionBy("query_id").orderBy(F.coalesce(effective_score(), F.lit(0.0)).desc(), "rank")
    return candidates.withColumn("rank", F.row_number().over(by))


def above(candidates: DataFrame, least: float) -> DataFrame:
    """FL-03: without a score a candidate passes only if nothing positive is asked for."""
    return candidates.filter(F.coalesce(effective_score() >= least, F.lit(least <= 0)))


def renumbered(candidates: DataFrame) -> DataFrame:
    """WN-01: ranks without gaps, in the order they have."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def distinct_files(candidates: DataFrame) -> DataFrame:
    """RT-19: files in order of their best candidate."""
    first = candidates.filter(blank_to_null(F.col("filename")).isNotNull()).groupBy("query_id", "filename").agg(F.min("rank").alias("rank"))
    return renumbered(first)


def expected_ranks(expected: DataFrame, candidates: DataFrame) -> DataFrame:
    """RT-20: rank of each expected file (``query_id, filename``) in the list of distinct files, null if absent."""
    return expected.join(distinct_files(candidates), ["query_id", "filename"], "left")


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """SRC-15: rows with the asked ids, whatever their level; blank ids ask for nothing."""
    asked = ids.filter(F.trim("chunk_id") != "").select("chunk_id").distinct()
    return chunks.join(small(asked), "chunk_id", "left_semi")


def in_request_order(parents: DataFrame, request: DataFrame) -> DataFrame:
    """SRC-16: ``request`` (pos, chunk_id) with the parent's columns; unknown ids drop out, repeated ones repeat."""
    return request.join(parents, "chunk_id")

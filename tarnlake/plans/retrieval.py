"""Queries on retrieval and what follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import storage
from tarnlake.functions import text as T
from tarnlake.operators import inverted, merging, retrieval
from tarnlake.plans import corpus
from tarnlake.plans.registry import CANDIDATES, CHUNKS, LEAF, QUESTIONS, TOKEN_SQL, bm25_sql, merge_sql, query, questions, table, with_

DOC_CORPUS = "corpus AS (SELECT 'd' || doc_id AS chunk_id, text FROM documents)"
TWO_STEPS = CANDIDATES + "," + merge_sql("cand", "one") + "," + merge_sql("one", "two")
#: A question's first eight tokens, as a second way of asking: the stand-in for a rewriting model.
REWRITES = f"rewritten AS (SELECT item_id AS query_id, array_to_string(list_slice(regexp_extract_all(lower(text), {TOKEN_SQL}), 1, 8), ' ') AS text FROM benchmark)"
JACCARD = f"""
round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), {TOKEN_SQL})), list_distinct(regexp_extract_all(lower(t.text), {TOKEN_SQL})))) /
  nullif(len(list_distinct(list_concat(regexp_extract_all(lower(q.text), {TOKEN_SQL}), regexp_extract_all(lower(t.text), {TOKEN_SQL})))), 0), 6)
"""
RERANKED = TWO_STEPS + f""",
scored AS (SELECT c.query_id, c.rank AS rrf_rank, c.chunk_id, c.chunk_level, c.filename, c.score, coalesce({JACCARD}, 0.0) AS rerank_score FROM two c JOIN asked q USING (query_id) JOIN chunk t USING (chunk_id)),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank)::INT AS rank FROM scored) WHERE rank <= 8)
"""


def documents_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("chunk_id"), "embedding", "vec_id")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th vector asks."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


@query("bm25_topk", with_(DOC_CORPUS, QUESTIONS, bm25_sql("corpus", "asked", "hits", 10)) + "SELECT query_id, rank, chunk_id, score FROM hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(corpus.index(spark, sf_dir, "documents"), questions(spark, sf_dir), 10).select("query_id", "rank", "chunk_id", "score")


#: Documents that are left when every seventh is deleted.
LEFT_CORPUS = "corpus AS (SELECT 'd' || doc_id AS chunk_id, text FROM documents WHERE doc_id % 7 <> 3)"


def segmented_index(spark: SparkSession, sf_dir: str) -> inverted.Index:
    """Documents in three ingests, the second and third with some of what is there already, and every seventh deleted between them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text")
    i = F.col("doc_id")
    index = inverted.open_index(spark, storage.new_folder(spark, "segments"))
    index = inverted.ingest(index, docs.filter(i % 3 == 0))
    index = inverted.ingest(index, docs.filter(i % 3 <= 1))
    index = inverted.delete(index, docs.filter(i % 7 == 3))
    index = inverted.ingest(index, docs.filter((i % 3 == 2) | (i % 7 == 4)))
    return inverted.delete(index, docs.filter(i % 7 == 3))


@query("segmented_bm25", with_(LEFT_CORPUS, QUESTIONS, bm25_sql("corpus", "asked", "hits", 10)) + "SELECT query_id, rank, chunk_id, score FROM hits")
def segmented_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02, SNK-05, SM-10: an index that grew by segments and lost chunks answers like one built of what is left."""
    return retrieval.search(segmented_index(spark, sf_dir), questions(spark, sf_dir), 10).select("query_id", "rank", "chunk_id", "score")


@query("compacted_bm25", with_(LEFT_CORPUS, QUESTIONS, bm25_sql("corpus", "asked", "hits", 10)) + "SELECT query_id, rank, chunk_id, score FROM hits")
def compacted_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: the same when its segments have been made one."""
    return retrieval.search(inverted.compact(segmented_index(spark, sf_dir)), questions(spark, sf_dir), 10).select("query_id", "rank", "chunk_id", "score")


DENSE_SQL = """
dense AS (SELECT query_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT q.vec_id AS query_id, 'd' || e.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE rank <= 16)
"""


@query("dense_topk", with_(DENSE_SQL) + "SELECT query_id, rank, chunk_id, score FROM dense WHERE rank <= 8")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dense(vectors(spark, sf_dir), vector_questions(spark, sf_dir), 8).select("query_id", "rank", "chunk_id", "score")


HYBRID_ASKED = "asked AS (SELECT v.vec_id AS query_id, d.text FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id % 20 = 0)"


@query("hybrid_rrf", with_(DOC_CORPUS, HYBRID_ASKED, bm25_sql("corpus", "asked", "lex", 16), DENSE_SQL) + """
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
  SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM lex UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY ALL)) WHERE rank <= 8
""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-03; the columns don't tell which arms ran, so one that fails ends the query."""
    asked = vector_questions(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text"), "query_id", "left")
    return retrieval.retrieve("hybrid", corpus.index(spark, sf_dir, "documents"), vectors(spark, sf_dir), asked, 8, fall_back=False).select("query_id", "rank", "chunk_id", "score")


@query("retrieval_filters", with_(LEAF) + "SELECT chunk_id, filename FROM leaf WHERE filename IN ('doc_1.md', 'doc_7.md', 'doc_31.md')")
def retrieval_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.allowed_files(retrieval.leaves(corpus.chunks(spark, sf_dir)), [" doc_1.md", "doc_7.md", "", "doc_31.md", "doc_1.md"]).select("chunk_id", "filename")


@query("document_stats", with_(CHUNKS) + "SELECT filename, 'Markdown' AS file_type, count(*) AS chunk_count FROM chunk GROUP BY filename")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-01, without the cap on scanned rows."""
    c = corpus.chunks(spark, sf_dir).select("filename", T.file_type(F.col("filename")).alias("file_type"))
    return c.groupBy("filename").agg(F.min("file_type").alias("file_type"), F.count("*").alias("chunk_count"))


@query("line_chunks", with_(CHUNKS) + "SELECT chunk_id, parent_chunk_id, root_chunk_id, chunk_level, chunk_idx, md5(text) AS text_md5, CASE WHEN chunk_level = 3 THEN regexp_extract(chunk_id, '([0-9]+)$', 1)::INT END AS leaf_number FROM chunk")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(spark, sf_dir).select("chunk_id", "parent_chunk_id", "root_chunk_id", "chunk_level", "chunk_idx", F.md5("text").alias("text_md5"), T.chunk_number(F.col("chunk_id")).alias("leaf_number"))


MERGED = "query_id, rank, chunk_id, chunk_level, score, merged AS merged_child_count"


def _merged(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "chunk_id", "chunk_level", "score", "merged_child_count")


@query("auto_merge_l3_l2", with_(TWO_STEPS) + f"SELECT {MERGED} FROM one")
def auto_merge_l3_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.candidates(spark, sf_dir).withColumn("merged_child_count", F.lit(None).cast("long"))
    return _merged(merging.merge_parents(c, corpus.parent_ids(spark, sf_dir, corpus.files_of(c))))


@query("auto_merge_two_pass", with_(TWO_STEPS) + f"SELECT {MERGED} FROM two")
def auto_merge_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.candidates(spark, sf_dir)
    return _merged(merging.auto_merge(c, corpus.parent_ids(spark, sf_dir, corpus.files_of(c))))


@query("auto_merge_meta", with_(TWO_STEPS) + """
, pre AS (SELECT query_id, count(*) AS pre FROM cand GROUP BY 1), post AS (SELECT query_id, count(*) AS post FROM two GROUP BY 1),
g1 AS (SELECT query_id, sum(merged) AS g FROM one WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM cand) GROUP BY 1),
g2 AS (SELECT query_id, sum(merged) AS g FROM two WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM one) GROUP BY 1)
SELECT query_id, pre, post, (coalesce(g1.g, 0) + coalesce(g2.g, 0))::BIGINT AS replaced, (coalesce(g1.g, 0) > 0)::INT + (coalesce(g2.g, 0) > 0)::INT AS steps
FROM pre JOIN post USING (query_id) LEFT JOIN g1 USING (query_id) LEFT JOIN g2 USING (query_id)
""")
def auto_merge_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.candidates(spark, sf_dir)
    return merging.auto_merge_meta(c, corpus.parent_ids(spark, sf_dir, corpus.files_of(c)))


ADJACENT = CANDIDATES + """,
requested AS (SELECT c.query_id, c.rank, c.chunk_id AS from_id, s.side, c.filename || '::p0::l3::' || (regexp_extract(c.chunk_id, '([0-9]+)$', 1)::INT + s.side) AS chunk_id
  FROM cand c, (VALUES (-1), (1)) s(side) WHERE regexp_extract(c.chunk_id, '([0-9]+)$', 1)::INT + s.side >= 0),
fresh AS (SELECT query_id, chunk_id, min(rank * 10 + side) AS first, count(*) AS origins FROM requested WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM cand) AND chunk_id IN (SELECT chunk_id FROM leaf) GROUP BY ALL)
"""


@query("adjacent_expand", with_(ADJACENT) + """
SELECT query_id, rank::INT AS rank, chunk_id, score, false AS adjacent_added FROM cand UNION ALL
SELECT query_id, (last + row_number() OVER (PARTITION BY query_id ORDER BY first))::INT, chunk_id, NULL, true FROM fresh JOIN (SELECT query_id, max(rank) AS last FROM cand GROUP BY 1) USING (query_id)
""")
def adjacent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.candidates(spark, sf_dir)
    return merging.expand_neighbours(c, corpus.leaves(spark, sf_dir, files=corpus.files_of(c))).select("query_id", "rank", "chunk_id", "score", "adjacent_added")


#: Candidates some of which are no leaves, by their id, their level or both.
MIXED = """,
mixed AS (SELECT query_id, rank, CASE WHEN query_id % 7 = 0 OR (rank % 5 = 0) THEN parent_chunk_id WHEN rank % 11 = 0 THEN '::p0::l3::1' WHEN rank % 13 = 0 THEN '  ' ELSE chunk_id END AS chunk_id, CASE WHEN rank % 5 = 0 THEN 2 WHEN rank % 6 = 0 THEN NULL WHEN rank % 9 = 0 THEN 1 ELSE 3 END AS chunk_level FROM cand),
told AS (SELECT *, CASE WHEN NOT regexp_full_match(trim(chunk_id), '.+::p[0-9]+::l3::[0-9]+') THEN 'unparseable_l3_chunk_id' WHEN chunk_level IS NOT NULL AND chunk_level <> 3 THEN 'candidate_not_l3' END AS reason FROM mixed)
"""


def mixed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rank")
    name = F.when((F.col("query_id") % 7 == 0) | (r % 5 == 0), F.col("parent_chunk_id")).when(r % 11 == 0, "::p0::l3::1").when(r % 13 == 0, "  ").otherwise(F.col("chunk_id"))
    level = F.when(r % 5 == 0, 2).when(r % 6 == 0, None).when(r % 9 == 0, 1).otherwise(3)
    return corpus.candidates(spark, sf_dir).withColumn("chunk_id", name).withColumn("chunk_level", level)


@query("adjacent_meta", with_(CANDIDATES + MIXED) + """
, want AS (SELECT DISTINCT query_id, regexp_extract(chunk_id, '^(.+::)[0-9]+$', 1) || (regexp_extract(chunk_id, '([0-9]+)$', 1)::INT + s.side) AS chunk_id FROM told, (VALUES (-1), (1)) s(side) WHERE reason IS NULL AND regexp_extract(chunk_id, '([0-9]+)$', 1)::INT + s.side >= 0),
have AS (SELECT DISTINCT query_id, chunk_id FROM mixed),
n AS (SELECT query_id, count(*) FILTER (reason = 'unparseable_l3_chunk_id') AS unparseable, count(*) FILTER (reason = 'candidate_not_l3') AS not_leaf FROM told GROUP BY 1),
r AS (SELECT query_id, count(*) AS requested, count(*) FILTER ((query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM have)) AS present, count(*) FILTER ((query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM have) AND chunk_id IN (SELECT chunk_id FROM leaf)) AS added FROM want GROUP BY 1)
SELECT query_id, unparseable, not_leaf, coalesce(requested, 0) AS requested, coalesce(present, 0) AS present, coalesce(added, 0) AS added,
  CASE WHEN coalesce(requested, 0) = 0 THEN 'no_parseable_l3_candidates' WHEN unparseable + not_leaf > 0 THEN 'unparseable_l3_candidates_skipped' END AS fallback_reason FROM n LEFT JOIN r USING (query_id)
""")
def adjacent_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mixed_candidates(spark, sf_dir)
    return merging.neighbour_meta(c, corpus.leaves(spark, sf_dir, files=corpus.files_of(c)))


@query("adjacent_skips", with_(CANDIDATES + MIXED) + "SELECT query_id, rank AS candidate_index, reason FROM told WHERE reason IS NOT NULL")
def adjacent_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-13: which candidates asked for nothing, and why."""
    return merging.neighbour_skips(mixed_candidates(spark, sf_dir))


FUSED = LEAF + "," + QUESTIONS + "," + REWRITES + "," + bm25_sql("leaf", "asked", "h1", 24) + "," + bm25_sql("leaf", "rewritten", "h2", 24) + """,
every AS (SELECT query_id, chunk_id, score, 0 AS list, rank, 'initial' AS source FROM h1 UNION ALL SELECT query_id, chunk_id, score, 1, rank, 'rewritten' FROM h2),
fused AS (SELECT query_id, chunk_id, max(score) AS score, min(list * 1000 + rank) AS place, count(DISTINCT source) AS n, min(source) AS s FROM every GROUP BY ALL)
"""


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    return q.select("query_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 8), " ").alias("text"))


@query("rewrite_fusion", with_(FUSED) + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank, chunk_id, score, CASE WHEN n = 2 THEN 'both' ELSE s END AS label FROM fused")
def rewrite_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-14, RT-15: candidates of every question and of its rewriting, which is the question's first eight tokens here."""
    return merging.fuse_rewrites(corpus.candidates(spark, sf_dir), corpus.candidates(spark, sf_dir, asked=rewrites(spark, sf_dir)))


@query("fusion_fallback", with_(FUSED) + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank, chunk_id, score, NULL::VARCHAR AS fallback_reason FROM fused WHERE query_id % 2 = 0
UNION ALL SELECT query_id, rank, chunk_id, score, 'no_rewritten_candidates' FROM h1 WHERE query_id % 2 <> 0
""")
def fusion_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second recall of questions with odd numbers fails here."""
    return merging.fuse_or_keep(corpus.candidates(spark, sf_dir), corpus.candidates(spark, sf_dir, asked=rewrites(spark, sf_dir).filter("query_id % 2 = 0")))


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.candidates(spark, sf_dir)
    files = corpus.files_of(c)
    merged = merging.auto_merge(c, corpus.parent_ids(spark, sf_dir, files))
    return merging.rerank(merged, questions(spark, sf_dir), corpus.texts(spark, sf_dir, files), 8)


@query("rerank_overlap", with_(RERANKED) + "SELECT query_id, rank, rrf_rank, chunk_id, rerank_score FROM reranked")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "rank", "rrf_rank", "chunk_id", "rerank_score")


@query("rerank_threshold", with_(RERANKED) + "SELECT query_id, rank, chunk_id, rerank_score FROM reranked WHERE rerank_score >= 0.1")
def rerank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.above(_reranked(spark, sf_dir), 0.1).select("query_id", "rank", "chunk_id", "rerank_score")


@query("finalize_pipeline", with_(RERANKED) + """
, final AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, rerank_score FROM reranked WHERE rerank_score >= 0.1)
SELECT query_id, n AS candidate_count, coalesce(m, 0) AS final_count, best AS best_score FROM (SELECT query_id, count(*) AS n FROM cand GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS m, max(rerank_score) AS best FROM final GROUP BY 1) USING (query_id)
""")
def finalize_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.candidates(spark, sf_dir)
    files = corpus.files_of(c)
    final = merging.finalise(c, corpus.parent_ids(spark, sf_dir, files), questions(spark, sf_dir), corpus.texts(spark, sf_dir, files), 8, 0.1)
    return merging.finalise_meta(c, final)


STAGES_SQL = RERANKED + """,
stage AS (
  SELECT query_id, 'recalled' AS stage, rank, chunk_id FROM cand UNION ALL SELECT query_id, 'merged', rank, chunk_id FROM two UNION ALL SELECT query_id, 'rerank_input', rank, chunk_id FROM two UNION ALL SELECT query_id, 'reranked', rank, chunk_id FROM reranked
  UNION ALL SELECT query_id, 'not_returned', row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT, chunk_id FROM two WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM reranked)
  UNION ALL SELECT query_id, 'threshold_rejected', row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT, chunk_id FROM reranked WHERE rerank_score < 0.1
  UNION ALL SELECT query_id, 'final', row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT, chunk_id FROM reranked WHERE rerank_score >= 0.1)
"""


def candidate_stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each list feeds several stages; they are small (a few rows per question)
    c = corpus.candidates(spark, sf_dir)
    files = corpus.files_of(c)
    merged = storage.stored(spark, merging.auto_merge(c, corpus.parent_ids(spark, sf_dir, files)), "merged")
    ranked = storage.stored(spark, merging.rerank(merged, questions(spark, sf_dir), corpus.texts(spark, sf_dir, files), 8), "reranked")
    final = retrieval.above(ranked, 0.1)
    return merging.stages(recalled=c, merged=merged, rerank_input=merged, reranked=ranked, not_returned=merging.lost(merged, ranked), threshold_rejected=merging.lost(ranked, final), final=retrieval.renumbered(final))


@query("candidate_stages", with_(STAGES_SQL) + "SELECT query_id, stage, rank, chunk_id FROM stage")
def candidate_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_stage_table(spark, sf_dir)


@query("synthesis_dedup", with_(LEAF, f"halves AS (SELECT item_id, b AS branch, array_to_string(CASE WHEN b = 0 THEN list_slice(ts, 1, len(ts) // 2) ELSE list_slice(ts, len(ts) // 2 + 1, len(ts)) END, ' ') AS text FROM (SELECT item_id, regexp_extract_all(lower(text), {TOKEN_SQL}) AS ts FROM benchmark), (VALUES (0), (1)) v(b))", "asked AS (SELECT item_id * 2 + branch AS query_id, text FROM halves)", bm25_sql("leaf", "asked", "hits", 8)) + """
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank, chunk_id, score FROM (SELECT query_id // 2 AS query_id, chunk_id, max(score) AS score, min((query_id % 2) * 100 + rank) AS place FROM hits GROUP BY ALL)
""")
def synthesis_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-18: two sub-questions each, their candidates joined in branch order."""
    ts = questions(spark, sf_dir).select("query_id", T.tokens(F.col("text")).alias("ts"), F.explode(F.array(F.lit(0), F.lit(1))).alias("branch"))
    half = F.floor(F.size("ts") / 2).cast("int")
    part = F.when(F.col("branch") == 0, F.slice("ts", F.lit(1), half)).otherwise(F.slice("ts", half + 1, F.size("ts")))
    asked = ts.select((F.col("query_id") * 2 + F.col("branch")).alias("query_id"), F.array_join(part, " ").alias("text"))
    c = corpus.candidates(spark, sf_dir, 8, asked)
    c = c.withColumn("rank", (F.col("query_id") % 2) * 100 + F.col("rank")).withColumn("query_id", F.floor(F.col("query_id") / 2))
    return merging.deduplicate(c).select("query_id", "rank", "chunk_id", "score")


@query("parent_lookup_ordered", with_(CHUNKS) + "SELECT r.pos::INT AS pos, c.chunk_id, c.chunk_level FROM (VALUES (0, 'doc_9.md::p0::l1::0'), (1, 'doc_2.md::p0::l2::0'), (2, 'missing'), (3, 'doc_9.md::p0::l1::0'), (4, 'doc_1.md::p0::l3::0')) r(pos, chunk_id) JOIN chunk c USING (chunk_id) WHERE c.chunk_level < 3")
def parent_lookup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = spark.createDataFrame([(0, "doc_9.md::p0::l1::0"), (1, "doc_2.md::p0::l2::0"), (2, "missing"), (3, "doc_9.md::p0::l1::0"), (4, "doc_1.md::p0::l3::0")], "pos int, chunk_id string")
    return retrieval.in_request_order(corpus.parents(corpus.leaves(spark, sf_dir)), request).select("pos", "chunk_id", "chunk_level").orderBy("pos")


@query("id_point_lookup", with_(CHUNKS) + "SELECT chunk_id, chunk_level, text FROM chunk WHERE chunk_id IN ('doc_3.md::p0::l3::0', 'doc_3.md::p0::l2::0', 'doc_5.md::p0::l1::0')")
def id_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([("doc_3.md::p0::l3::0",), ("",), ("doc_3.md::p0::l2::0",), ("doc_5.md::p0::l1::0",), ("nothing",)], "chunk_id string")
    return retrieval.by_ids(corpus.chunks(spark, sf_dir), ids).select("chunk_id", "chunk_level", "text")


@query("flagship_context", with_(TWO_STEPS) + """
, top AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, rank)::INT AS rank, chunk_id, chunk_level, filename, score FROM two) WHERE rank <= 8)
SELECT query_id, rank, chunk_id, chunk_level, score, filename, string_agg('[' || rank || '] ' || filename || ' (Page 0):' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS context FROM top JOIN (SELECT chunk_id, text FROM chunk) USING (chunk_id)
""")
def flagship_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, parent recovery, top 8 by score, threshold, context string (RT-02, RT-07, RT-09, FL-03, TX-24)."""
    c = corpus.candidates(spark, sf_dir)
    files = corpus.files_of(c)
    merged = merging.auto_merge(c, corpus.parent_ids(spark, sf_dir, files))
    top = retrieval.above(retrieval.by_score(merged).filter("rank <= 8"), 0.0)
    full = top.select("query_id", "rank", "chunk_id", "chunk_level", "score", "filename").join(corpus.texts(spark, sf_dir, files), "chunk_id")
    entry = T.context_entry(F.col("rank"), F.col("filename"), F.lit(0), F.col("text"))
    context = full.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))), lambda s: s["e"]), T.CONTEXT_JOINT).alias("context"))
    return full.select("query_id", "rank", "chunk_id", "chunk_level", "score", "filename").join(context, "query_id")

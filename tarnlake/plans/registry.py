"""Registration of queries with their DuckDB twins, and the SQL pieces that twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOKEN_SQL = r"'[\p{L}\p{N}_]+'"


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


#: The line profile (a test corpus shape, not an operator of the engine): a leaf is a line that is not blank, four leaves make a
#: level 2 chunk, the document is level 1.
LINES = """
lines AS (
  SELECT doc_id, 'doc_' || doc_id || '.md' AS filename, unnest(t) AS text, unnest(range(len(t))) AS l3 FROM (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS t FROM documents))
"""
LEAF = LINES + """,
leaf AS (
  SELECT doc_id, filename, filename || '::p0::l3::' || l3 AS chunk_id, filename || '::p0::l2::' || (l3 // 4) AS parent_chunk_id, filename || '::p0::l1::0' AS root_chunk_id, 3 AS chunk_level, l3, text FROM lines)
"""
CHUNKS = LEAF + """,
chunk AS (
  SELECT filename, chunk_id, parent_chunk_id, root_chunk_id, chunk_level, (2 + l3 + l3 // 4)::BIGINT AS chunk_idx, text FROM leaf
  UNION ALL
  SELECT filename, parent_chunk_id, root_chunk_id, root_chunk_id, 2, (1 + 5 * (min(l3) // 4))::BIGINT, string_agg(text, chr(10) ORDER BY l3) FROM leaf GROUP BY filename, parent_chunk_id, root_chunk_id
  UNION ALL
  SELECT filename, root_chunk_id, '', root_chunk_id, 1, 0::BIGINT, string_agg(text, chr(10) ORDER BY l3) FROM leaf GROUP BY filename, root_chunk_id)
"""


def bm25_sql(source: str, asked: str, out: str, k: int) -> str:
    """CTEs that rank ``source`` (chunk_id, text) for ``asked`` (query_id, text) into ``out``."""
    return f"""
{out}_tok AS (SELECT chunk_id, regexp_extract_all(lower(text), {TOKEN_SQL}) AS ts FROM {source}),
{out}_dl AS (SELECT chunk_id, len(ts) AS dl FROM {out}_tok),
{out}_tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM {out}_tok) GROUP BY ALL),
{out}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {out}_dl),
{out}_df AS (SELECT term, count(*) AS df FROM {out}_tf GROUP BY term),
{out}_q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), {TOKEN_SQL})) AS term FROM {asked}),
{out}_sc AS (SELECT q.query_id, tf.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM {out}_q q JOIN {out}_tf tf USING (term) JOIN {out}_df USING (term) JOIN {out}_dl USING (chunk_id), {out}_st GROUP BY ALL),
{out} AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM {out}_sc) WHERE rank <= {k})
"""


QUESTIONS = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"


def merge_sql(source: str, out: str) -> str:
    """CTEs for one merging step of ``source`` (query_id, rank, chunk_id, parent_chunk_id, chunk_level, filename, score, rerank_score, merged)."""
    return f"""
{out}_k AS (SELECT c.*, p.chunk_id AS p_id, p.parent_chunk_id AS p_parent, p.chunk_level AS p_level, p.filename AS p_file, count(*) OVER (PARTITION BY c.query_id, coalesce(nullif(trim(c.parent_chunk_id), ''), chr(1) || c.chunk_id)) AS n
  FROM {source} c LEFT JOIN (SELECT * FROM chunk WHERE chunk_level < 3) p ON nullif(trim(c.parent_chunk_id), '') = p.chunk_id),
{out} AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, chunk_id, parent_chunk_id, chunk_level, filename, score, rerank_score, merged FROM (
  SELECT query_id, rank, chunk_id, parent_chunk_id, chunk_level, filename, score, rerank_score, merged FROM {out}_k WHERE NOT (n >= 2 AND p_id IS NOT NULL)
  UNION ALL
  SELECT query_id, min(rank), p_id, any_value(p_parent), any_value(p_level), any_value(p_file), max(score), max(rerank_score), count(*) FROM {out}_k WHERE n >= 2 AND p_id IS NOT NULL GROUP BY query_id, p_id))
"""


#: Top 24 leaves for every question, with the columns of a candidate.
CANDIDATES = CHUNKS + "," + QUESTIONS + "," + bm25_sql("leaf", "asked", "hits", 24) + """,
cand AS (SELECT h.query_id, h.rank, h.chunk_id, l.parent_chunk_id, 3 AS chunk_level, l.filename, h.score, NULL::DOUBLE AS rerank_score, NULL::BIGINT AS merged FROM hits h JOIN leaf l USING (chunk_id))
"""

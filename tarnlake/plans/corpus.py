"""Line-profile corpus and the candidate lists that other plans start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake import storage
from tarnlake.operators import inverted, retrieval
from tarnlake.plans.registry import questions, table

PER_BLOCK = 4


def leaves(spark: SparkSession, sf_dir: str, per_block: int = PER_BLOCK, files: DataFrame | None = None) -> DataFrame:
    """Leaves of all documents, or of the files in ``files``, the others being left out before their texts are cut."""
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename"), "text")
    return _cut(named if files is None else named.join(files, "filename", "left_semi"), per_block)


def leaves_of(docs: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """Leaves of the given ``doc_id, text`` rows."""
    return _cut(docs.select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename"), "text"), per_block)


def _cut(named: DataFrame, per_block: int) -> DataFrame:
    docs = named.select("doc_id", "filename", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("t"))
    lines = docs.select("doc_id", "filename", F.posexplode("t").alias("l3", "text"))
    name = lambda level, i: F.concat("filename", F.lit(f"::p0::l{level}::"), i.cast("string"))
    return lines.select("doc_id", "filename", name(3, F.col("l3")).alias("chunk_id"), name(2, F.floor(F.col("l3") / per_block)).alias("parent_chunk_id"), name(1, F.lit(0)).alias("root_chunk_id"), F.lit(3).alias("chunk_level"), "l3", "text")


def parents(leaf: DataFrame) -> DataFrame:
    """Levels 1 and 2, texts put together from their leaves."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l3", "text"))), lambda s: s["text"]), "\n").alias("text")
    two = leaf.groupBy("filename", "parent_chunk_id", "root_chunk_id").agg(joined, (1 + 5 * F.floor(F.min("l3") / PER_BLOCK)).alias("chunk_idx"))
    one = leaf.groupBy("filename", "root_chunk_id").agg(joined)
    return two.select("filename", F.col("parent_chunk_id").alias("chunk_id"), F.col("root_chunk_id").alias("parent_chunk_id"), "root_chunk_id", F.lit(2).alias("chunk_level"), F.col("chunk_idx").cast("long").alias("chunk_idx"), "text").unionByName(
        one.select("filename", F.col("root_chunk_id").alias("chunk_id"), F.lit("").alias("parent_chunk_id"), "root_chunk_id", F.lit(1).alias("chunk_level"), F.lit(0).cast("long").alias("chunk_idx"), "text")
    )


def files_of(candidates: DataFrame) -> DataFrame:
    """``filename`` of each candidate, once; marked for broadcasting if they are few."""
    return retrieval.small(candidates.select(F.substring_index("chunk_id", "::", 1).alias("filename")).distinct(), width=64)


def parent_ids(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """Levels 1 and 2 without their texts."""
    leaf = leaves(spark, sf_dir, files=files)
    two = leaf.select("filename", F.col("parent_chunk_id").alias("chunk_id"), F.col("root_chunk_id").alias("parent_chunk_id"), F.lit(2).alias("chunk_level")).distinct()
    one = leaf.select("filename", F.col("root_chunk_id").alias("chunk_id"), F.lit("").alias("parent_chunk_id"), F.lit(1).alias("chunk_level")).distinct()
    return two.unionByName(one)


def chunks(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    leaf = leaves(spark, sf_dir, files=files)
    own = leaf.select("filename", "chunk_id", "parent_chunk_id", "root_chunk_id", "chunk_level", (2 + F.col("l3") + F.floor(F.col("l3") / PER_BLOCK)).cast("long").alias("chunk_idx"), "text")
    return own.unionByName(parents(leaf))


def texts(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    return chunks(spark, sf_dir, files).select("chunk_id", "text")


def texts_of(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    """Texts of one level: leaves need no putting together."""
    if level == 3:
        return leaves(spark, sf_dir).select("chunk_id", "text")
    return parents(leaves(spark, sf_dir)).filter(F.col("chunk_level") == level).select("chunk_id", "text")


def index(spark: SparkSession, sf_dir: str, of: str) -> retrieval.Index:
    """The stored index of ``documents`` or of their ``leaves``, built once for each state of the documents and searched by every query.

    It stays in the shared folder, where another application finds it.
    """
    docs = table(spark, sf_dir, "documents")

    def rows() -> DataFrame:
        if of == "documents":
            return docs.select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text")
        return leaves(spark, sf_dir).select("chunk_id", "text")

    return inverted.kept_index(spark, f"index-{of}", storage.version_of(docs), rows)


def as_candidates(hits: DataFrame) -> DataFrame:
    """Leaf ids carry file and number, so nothing need be joined: the parent follows from the number."""
    n = F.regexp_extract("chunk_id", r"::l3::(\d+)$", 1).cast("int")
    file = F.substring_index("chunk_id", "::", 1)
    parent = F.concat(file, F.lit("::p0::l2::"), F.floor(n / PER_BLOCK).cast("string"))
    return hits.select("query_id", "rank", "chunk_id", parent.alias("parent_chunk_id"), F.lit(3).alias("chunk_level"), file.alias("filename"), "score", F.lit(None).cast("double").alias("rerank_score"))


def candidates(spark: SparkSession, sf_dir: str, k: int = 24, asked: DataFrame | None = None) -> DataFrame:
    """``k`` leaves for each question, by the stored index; written, as most plans read them several times."""
    hits = retrieval.search(index(spark, sf_dir, "leaves"), questions(spark, sf_dir) if asked is None else asked, k)
    return storage.stored(spark, as_candidates(hits), "candidates")

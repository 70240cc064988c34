"""Reading documents, evaluation sets and tables (SRC-01 to SRC-17)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.storage import numbered
from tarnlake.functions import html
from tarnlake.functions.text import file_type

#: Rows that one scalar query may return.
MOST_ROWS = 16384
NATIVE = ("Text", "Markdown", "HTML")


@F.pandas_udf(T.StringType())
def _html_text(data: pd.Series) -> pd.Series:
    return data.map(lambda b: html.decode(bytes(b)), na_action="ignore")


def decoded(content: Column) -> Column:
    """SRC-02: text of a page's bytes."""
    return _html_text(content)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: whole files, a leading byte order mark off."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("filename"), F.regexp_replace("value", "\\A\ufeff", "").alias("text"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), _html_text(F.col("content")).alias("html"))


def read_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-03, SRC-04: documents of native types below a folder, and what is refused with its reason instead of being skipped in silence. Empty files hold no document; the scan leaves them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("file_path"), "content")
    typed = files.withColumn("file_type", file_type(F.col("filename")))
    reason = F.when(F.col("file_type") == "Unsupported", "unsupported type").when(~F.col("file_type").isin(*NATIVE), "needs a converter").when((F.col("file_type") != "HTML") & ~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8")
    marked = typed.withColumn("reason", reason)
    good = marked.filter("reason IS NULL")
    text = F.when(F.col("file_type") == "HTML", _html_text(F.col("content"))).otherwise(F.regexp_replace(F.col("content").cast("string"), "\\A\ufeff", ""))
    return good.select("filename", "file_path", "file_type", text.alias("text")), marked.filter("reason IS NOT NULL").select("filename", "file_path", "file_type", "reason")


def page_ranges(documents: DataFrame, pages: str = "pages", most: int = 200) -> DataFrame:
    """SRC-05: ``documents`` with a row, ``first`` and ``last``, for each request to a converter that takes ``most`` pages; documents without pages have none."""
    n = F.col(pages)
    begins = F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"), F.lit(most).cast("long"))))
    return documents.withColumn("first", begins).withColumn("last", F.least(F.col("first") + (most - 1), n.cast("long")))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-06 to SRC-08: columns are pruned in the scan; ``count()`` reads no column."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def relevant_cases(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """SRC-09: queries with their relevant documents (score above 0); queries without any drop out."""
    good = qrels.filter("score > 0").groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("expected"))
    return queries.join(good, "query_id")


def multihop_cases(items: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """SRC-10: items (query, question_type, evidence_list, and the columns of their ``order``) as numbered cases; numbers count all items, empty queries drop out after."""
    link = F.transform("evidence_list", lambda e: F.coalesce(F.get_json_object(e, "$.url"), e))
    return numbered(items, order, "case_no").select("case_no", F.trim("query").alias("question"), F.regexp_replace("question_type", "_query$", "").alias("question_type"), link.alias("evidence")).filter(F.coalesce(F.col("question"), F.lit("")) != "")


def items_of(raw: DataFrame) -> DataFrame:
    """The items of documents with an array ``items``, as they are laid out in a source file."""
    return raw.select(F.posexplode("items").alias("pos", "i")).select("pos", "i.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """SRC-11: blank lines count for nothing; a row without a required field or an empty file is an error when read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    df = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    for c in required:
        missing = F.assert_true(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)), F.lit(f"a row has no {c}"))
        df = df.withColumn("__ok", missing).filter("__ok IS NULL").drop("__ok")
    if required and lines.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return df


def scalar_query(df: DataFrame, condition: str = "", columns: Sequence[str] = ("*",), limit: int = 10_000, offset: int = 0, order: str = "chunk_id") -> DataFrame:
    """SRC-12: filter, project and page; an empty condition takes all, the limit is held at 16384."""
    out = df.filter(condition) if condition.strip() else df
    return out.orderBy(order).offset(offset).limit(min(limit, MOST_ROWS)).select(*columns)


def full_scan(df: DataFrame, condition: str = "", columns: Sequence[str] = ("*",)) -> DataFrame:
    """SRC-13, SRC-14: no pages needed."""
    return (df.filter(condition) if condition.strip() else df).select(*columns)


def canonical_markdown(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """SRC-17, RT-22: all asked documents must exist and hold text; else an error names the first five that do not."""
    good = texts.filter(F.trim("text") != "")
    missing = [r.document_id for r in ids.select("document_id").distinct().join(good, "document_id", "left_anti").orderBy("document_id").limit(5).collect()]
    if missing:
        raise ValueError("missing documents: " + ", ".join(map(str, missing)))
    return good.join(ids.select("document_id").distinct(), "document_id", "left_semi").withColumn("text", F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))

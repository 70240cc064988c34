"""Mutations as new table versions, and span joins (SNK-01 to SNK-13, JN-01 to JN-03, JN-05, AG-20, AG-21, AG-24)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def create_tables(chunks: DataFrame, path: str) -> None:
    """SNK-01: chunks and their index, which :func:`tarnlake.operators.retrieval.search` reads."""
    from tarnlake.operators.retrieval import build_index

    chunks.write.mode("errorifexists").parquet(f"{path}/chunk")
    build_index(chunks, f"{path}/index")


def append_missing(target: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """SNK-02: what of ``new`` is not there yet; writing it again after a failure adds nothing twice."""
    return new.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def upsert(current: DataFrame, changes: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """SNK-03: the last version of each key, a change before what is there; blank keys are skipped.

    Of two changes of one version the one with the larger hash of all its columns counts.
    """
    own = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1))).filter(F.coalesce(F.trim(F.col(key)) != "", F.lit(False)))
    by = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("__new").desc(), F.xxhash64(*[F.col(f"`{c}`") for c in current.columns]).desc())
    return own.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n", "__new")


def parents_only(chunks: DataFrame) -> DataFrame:
    """SNK-04: fails on another level than 1 or 2."""
    ok = F.assert_true(F.coalesce(F.col("chunk_level").isin(1, 2), F.lit(False)), F.lit("only levels 1 and 2 are parents"))
    return chunks.withColumn("__ok", ok).filter("__ok IS NULL").drop("__ok")


def without_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-05."""
    return chunks.join(files.select("filename").distinct(), "filename", "left_anti")


def without_run(chunks: DataFrame, run: str) -> DataFrame:
    """SNK-06: in a table laid out by run this prunes a folder. Rows of no run stay."""
    return chunks.filter(~F.col("corpus_run_id").eqNullSafe(run))


def latest_valid(chunks: DataFrame) -> DataFrame:
    """SNK-07: of each file the newest version that has a leaf; a broken new version leaves the old one in force."""
    good = chunks.groupBy("filename", "version").agg(F.count_if(F.col("chunk_level") == 3).alias("leaves")).filter("leaves > 0")
    best = good.groupBy("filename").agg(F.max("version").alias("version"))
    return chunks.join(best, ["filename", "version"], "left_semi")


def rechunk(old: DataFrame, new: DataFrame, targets: DataFrame) -> DataFrame:
    """SNK-08: target files from ``new``, all others copied; a copied leaf without its vector is an error."""
    kept = old.join(targets.select("filename").distinct(), "filename", "left_anti")
    whole = F.assert_true((F.col("chunk_level") != 3) | F.col("has_vector"), F.lit("a copied leaf has no vector"))
    kept = kept.withColumn("__ok", whole).filter("__ok IS NULL").drop("__ok")
    return kept.unionByName(new.join(targets.select("filename").distinct(), "filename", "left_semi"))


def verify_count(chunks: DataFrame, expected: int) -> None:
    """SNK-09."""
    n = chunks.filter("chunk_level = 3").count()
    if n != expected:
        raise ValueError(f"{n} leaves were written, {expected} expected")


def append_checkpoint(records: DataFrame, path: str) -> None:
    """SNK-10: a committed append; readers see whole batches only."""
    records.write.mode("append").json(path)


def write_once(spark: SparkSession, df: DataFrame, path: str) -> None:
    """SNK-11: writing the same content again is harmless, other content is refused."""
    digest = lambda d: d.agg(F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    try:
        held = spark.read.schema(df.schema).parquet(path)
        same = digest(held) == digest(df)
    except Exception as e:  # no such path yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.mode("errorifexists").parquet(path)
        return
    if not same:
        raise ValueError(f"{path} holds other content")


def drop_run(spark: SparkSession, path: str, run: str) -> bool:
    """SNK-13: remove a run's folder; doing it twice is harmless, names that could leave the table are refused."""
    if not run or any(c in run for c in "/\\=*?[]{}") or run in (".", ".."):
        return False
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/corpus_run_id={run}")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _level(start: Column, end: Column) -> Column:
    """Smallest power of two that a span fits into, as an exponent."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")


def _bin(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def _own_bins(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bin of its own level that a span touches: two at most."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn("__bin", F.explode(F.sequence(_bin(F.col(start), F.col("__level")), _bin(last, F.col("__level")))))


def _bins_above(df: DataFrame, levels: list[int], start: str, end: str, strictly: bool) -> DataFrame:
    """A row for each bin, two at most on each of ``levels``, that a span touches and that is as wide as it or wider."""
    own = F.col("__level")
    every = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > own if strictly else x >= own)
    wide = df.withColumn("__level", F.explode(every))
    return _own_bins(wide, start, end)


def overlapping_spans(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN-01: leaves of two chunkings that share characters, by bins of powers of two.

    A span lies in one or two bins as wide as itself; a shorter one looks into the one or two bins that it touches on each
    width that the other side has (63 at most). A pair is found where its later start lies, once. So spans of one file spread over
    many keys, and what is compared grows with what is found and not with the square of a file.
    """
    a = old.select("filename", F.col("chunk_id").alias("old_id"), F.col("start").alias("old_start"), F.col("end").alias("old_end")).withColumn("__level", _level(F.col("old_start"), F.col("old_end")))
    b = new.select("filename", F.col("chunk_id").alias("new_id"), F.col("start").alias("new_start"), F.col("end").alias("new_end")).withColumn("__level", _level(F.col("new_start"), F.col("new_end")))
    widths = lambda df: sorted(r[0] for r in df.select("__level").filter("__level IS NOT NULL").distinct().collect())
    longer_old = _own_bins(a, "old_start", "old_end").join(_bins_above(b, widths(a), "new_start", "new_end", False), ["filename", "__level", "__bin"])
    longer_new = _bins_above(a, widths(b), "old_start", "old_end", True).join(_own_bins(b, "new_start", "new_end"), ["filename", "__level", "__bin"])
    both = longer_old.unionByName(longer_new).filter(F.col("__bin") == _bin(F.greatest("old_start", "new_start"), F.col("__level")))
    return both.filter("new_start < old_end AND new_end > old_start").select("filename", "old_id", "old_start", "old_end", "new_id", "new_start", "new_end")


def overlapping_spans_plain(old: DataFrame, new: DataFrame) -> DataFrame:
    """JN-01 by comparing all spans of a file: for few of them."""
    a = old.select("filename", F.col("chunk_id").alias("old_id"), F.col("start").alias("old_start"), F.col("end").alias("old_end"))
    b = new.select("filename", F.col("chunk_id").alias("new_id"), F.col("start").alias("new_start"), F.col("end").alias("new_end"))
    return a.join(b, "filename").filter("new_start < old_end AND new_end > old_start")


def uncontained(atoms: DataFrame, leaves: DataFrame) -> DataFrame:
    """JN-03: atoms that no single leaf holds. A leaf that holds an atom is at least as long and has a bin in which the atom starts."""
    leaf = leaves.select(F.col("filename").alias("f"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn("__level", _level(F.col("s"), F.col("e")))
    levels = sorted(r[0] for r in leaf.select("__level").filter("__level IS NOT NULL").distinct().collect())
    held = _own_bins(leaf, "s", "e").withColumnsRenamed({"__level": "l", "__bin": "b"})
    places = atoms.select("filename", "start", "end").distinct().withColumn("__own", _level(F.col("start"), F.col("end")))
    asked = places.withColumn("__level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("__own")))).withColumn("__bin", _bin(F.col("start"), F.col("__level")))
    inside = asked.join(held, (F.col("filename") == F.col("f")) & (F.col("__level") == F.col("l")) & (F.col("__bin") == F.col("b")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")), "left_semi")
    return atoms.join(inside.select("filename", "start", "end").distinct(), ["filename", "start", "end"], "left_anti").select(*atoms.columns)


def audit(overlaps: DataFrame) -> DataFrame:
    """AG-20: per file how many old and new leaves meet and how many spans agree exactly."""
    return overlaps.groupBy("filename").agg(F.count_distinct("old_id").alias("old_leaves"), F.count_distinct("new_id").alias("new_leaves"), F.count_if((F.col("old_start") == F.col("new_start")) & (F.col("old_end") == F.col("new_end"))).alias("exact"))


def audit_summary(evidence: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """AG-20: one row on a re-chunking: evidence leaves (case_id, filename, chunk_id, start, end; an unlocated one starts below 0)
    held against the new leaves (with heading_path) of their files.
    """
    files = evidence.select("filename").distinct()
    leaves = lambda df, name: df.join(files, "filename", "left_semi").agg(F.count("*").alias(name))
    b = new.select("filename", F.col("start").alias("s"), F.col("end").alias("e"), "heading_path")
    met = evidence.join(b, (evidence["filename"] == b["filename"]) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")) & (F.col("start") >= 0), "left").drop(b["filename"])
    one = met.groupBy("case_id", "chunk_id").agg(F.first("start").alias("start"), F.bool_or((F.col("s") == F.col("start")) & (F.col("e") == F.col("end"))).alias("exact"), F.count("s").alias("overlaps"), F.bool_or(F.contains("heading_path", F.lit(" > "))).alias("nested"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    cases = one.groupBy("case_id").agg(F.count_if(F.col("start") >= 0).alias("leaves"), F.count_if(F.coalesce("exact", F.lit(False))).alias("exact"), any_(F.col("nested")).alias("nested"), any_(F.col("overlaps") > 0).alias("met"), any_(F.col("start") < 0).alias("lost"))
    out = cases.agg(F.count("*").alias("case_count"), F.sum("leaves").alias("evidence_leaf_count"), F.sum("exact").alias("exact_leaf_count"), F.count_if("nested").alias("cases_with_nested_heading"), F.count_if("met").alias("cases_with_new_overlap"), F.count_if("lost").alias("cases_without_old_span"))
    return out.withColumn("changed_leaf_count", F.col("evidence_leaf_count") - F.col("exact_leaf_count")).crossJoin(leaves(old, "old_leaf_count")).crossJoin(leaves(new, "new_leaf_count"))


def content_kinds(chunks: DataFrame) -> DataFrame:
    """AG-24: leaves of each document by kind of content."""
    return chunks.filter("chunk_level = 3").groupBy("filename", F.coalesce("content_kind", F.lit("None")).alias("content_kind")).agg(F.count("*").alias("leaves")).orderBy("filename", "content_kind")


def located(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """JN-02: ``start, end`` of each leaf (filename, chunk_id, leaf_index, text) in its file's text (filename, text), both -1 if it is not there.

    A file's leaves are looked for in order, each from a leaf's length before the last one found, or else from the beginning.
    Rows stream by in that order; held is one file's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, body, last = None, "", 0
        for batch in batches:
            starts, keep = [], []
            for k, (name, index, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("filename", "leaf_index", "text")), strict=True)):
                if index is None:  # the file itself comes first
                    file, body, last = name, text or "", 0
                    continue
                if name != file:
                    file, body, last = name, "", 0
                text = text or ""
                at = body.find(text, max(0, last - len(text)))
                at = body.find(text) if at < 0 else at
                last = at if at >= 0 else last
                keep.append(k)
                starts.append((at, at + len(text) if at >= 0 else -1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in ("filename", "chunk_id", "leaf_index")), pa.array([a for a, _ in starts], pa.int64()), pa.array([b for _, b in starts], pa.int64())], ["filename", "chunk_id", "leaf_index", "start", "end"])

    files = sources.join(chunks.select("filename").distinct(), "filename", "left_semi").select("filename", F.lit("").alias("chunk_id"), F.lit(None).cast("long").alias("leaf_index"), "text")
    rows = chunks.select("filename", "chunk_id", F.col("leaf_index").cast("long").alias("leaf_index"), "text").unionByName(files)
    ordered = rows.repartition("filename").sortWithinPartitions("filename", F.col("leaf_index").asc_nulls_first())
    return ordered.mapInArrow(run, "filename string, chunk_id string, leaf_index long, start long, end long")


def target_manifest(reviews: DataFrame, documents: DataFrame, cases: DataFrame, baseline: DataFrame) -> DataFrame:
    """JN-05: the reviewed cases (case_id, source_ref, ...) with their document (doc_id, stable_filename, markdown_hash), case (expected
    document ids) and baseline record (coverage, verdict); a review that lacks one of them is an error.

    ``expected_document_ids`` names the source first if the case does not name it.
    """
    docs = documents.select(F.col("doc_id").alias("source_ref"), "stable_filename", "markdown_hash", F.lit(True).alias("__d"))
    asked = cases.select("case_id", F.col("expected_doc_ids").alias("__ids"), F.lit(True).alias("__c"))
    before = baseline.select("case_id", F.col("coverage").alias("baseline_coverage"), F.col("verdict").alias("baseline_verdict"), F.lit(True).alias("__b"))
    out = reviews.join(docs, "source_ref", "left").join(asked, "case_id", "left").join(before, "case_id", "left")
    whole = F.assert_true(F.coalesce(F.col("__d") & F.col("__c") & F.col("__b"), F.lit(False)), F.concat(F.lit("no document, case or baseline record for "), F.col("case_id").cast("string")))
    ids = F.coalesce("__ids", F.array().cast(cases.schema["expected_doc_ids"].dataType))
    named = F.when(F.array_contains(ids, F.col("source_ref")), ids).otherwise(F.concat(F.array("source_ref"), ids))
    return out.withColumn("__ok", whole).filter("__ok IS NULL").withColumn("expected_document_ids", named).drop("__ok", "__d", "__c", "__b", "__ids")


def target_documents(manifest: DataFrame) -> DataFrame:
    """JN-05: all documents that the targets need, once each."""
    return manifest.select(F.explode("expected_document_ids").alias("doc_id")).distinct()


def chunk_faults(chunks: DataFrame, most: int) -> DataFrame:
    """AG-21: ids or texts that occur twice, leaves too long, spans out of order."""
    ids = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("fault"), F.col("chunk_id").alias("what"))
    texts = chunks.filter("chunk_level = 3").groupBy("filename", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_text").alias("fault"), F.col("filename").alias("what"))
    long = chunks.filter((F.col("chunk_level") == 3) & (F.length("text") > most)).select(F.lit("long_leaf").alias("fault"), F.col("chunk_id").alias("what"))
    spans = chunks.filter("source_end_index <= source_start_index").select(F.lit("bad_span").alias("fault"), F.col("chunk_id").alias("what"))
    return ids.unionByName(texts).unionByName(long).unionByName(spans).groupBy("fault").agg(F.count("*").alias("n"))

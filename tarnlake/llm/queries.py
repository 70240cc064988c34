"""The registered queries of this folder: thin digests over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jpeg, langid, linededup, merkle, minhash, mixing, packing, periodic, pii, sharding, warc
from .shared import written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), emit_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), "a key for these queries")


def op3_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(spark, _read(spark, sf_dir, "documents"))
    first = plan.select("doc_id", "size", "source_size", "target", "taken", F.get("uses", F.lit(0))["position"].alias("position"), F.transform("uses", lambda u: u["position"]).alias("positions"))
    return first.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.external_shuffle(spark, _read(spark, sf_dir, "documents"), shards=8)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return dealt.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    archive = warc.write(spark, pages)
    return warc.read(spark, archive, pages.select("url", "page_id"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(spark, vectors, vectors.filter("vec_id % 20 = 0"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of all pages, by the host of their URL."""
    pages = _read(spark, sf_dir, "pages").select("page_id", linededup.host(F.col("url")).alias("host"), linededup.html_lines(F.col("html")).alias("text"))
    pages = written(spark, pages, "page-lines")  # read twice: to count lines and to drop them
    return linededup.drop_boilerplate(spark, pages, site="host").select("page_id", "host", "lines", "dropped", "text")


def op7_jpeg_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(jpeg.stored(spark, jpeg.media_column(_read(spark, sf_dir, "documents"))))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    names, prototypes = langid.fit(docs.filter(~langid.held_out()))
    return langid.classify(docs, names, prototypes, keep=["doc_id"]).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.digests(found, "doc_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth of which gets a repeating tail (:func:`periodic.planted`)."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.collapse(docs, rewrite=periodic.planted, key="doc_id", emit_text=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(spark, _read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack_binary": op1_pack_binary,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_mix_curriculum": op3_mix_curriculum,
    "op4_warc_index": op4_warc_index,
    "op5_learned_partitions": op5_learned_partitions,
    "op6_line_dedup": op6_line_dedup,
    "op7_jpeg_thumbnails": op7_jpeg_thumbnails,
    "op8_shuffle_shards": op8_shuffle_shards,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language": op10_language,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op4_warc_index": warc.OP4_SQL, "op6_line_dedup": linededup.OP6_SQL, "op11_decontamination": decontaminate.OP11_SQL, "op12_periodic_runs": periodic.OP12_SQL, "op13_merkle_manifest": merkle.OP13_SQL}

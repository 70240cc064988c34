"""A training corpus in five stages, each of which writes a table that the next one reads.

Language identification drops texts without a letter and long ones in no learned language; line deduplication takes boilerplate lines out per source and drops texts that
held nothing else; near-duplicate detection keeps one document of each group; mixing takes sources to their target
words, repeating or leaving out documents; packing cuts what is left into power-of-two pieces.

Defined cases: null and empty texts and texts without a letter go in the first stage; a null ``doc_id`` is a document of its own
to near-duplicate detection and stays, rows that share a ``doc_id`` are one document there and all stay or go together; null
sources are one source to line deduplication and to mixing; repeated rows are exact copies, of which those under one ``doc_id`` stay;
a null ``lang`` teaches nothing; very long texts are one row in every stage; extra columns travel along up to packing, but those
that an operator adds (``lines, dropped, lang_pred, score, size, position`` ...) are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import langid, linededup, minhash, mixing, packing
from tarnlake.llm.shared import new_folder, remove, scratch

#: A document's source stands for its site, as documents have no URL. Boilerplate is a line on over this share of a source's
#: documents, counting so many more without it. A source holds far more than one site's pages, so the share is
#: lower than op6's and more evidence is asked for (11 documents of a small source).
LINE_RATIO = 0.005
LINE_PRIOR = 1800

#: A text in no learned language has a score below half of what all but one in a hundred held-out labelled texts reach. Texts
#: of fewer characters have too few trigrams for their cosine to say anything, and stay.
SCORE_QUANTILE = 0.01
SCORE_SHARE = 0.5
SCORED_CHARS = 100


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null texts, texts without a letter and long ones unlike every learned language.

    The least score is found on all labelled documents that the prototypes were not fitted on. Where nothing was learned, every
    text with a letter stays.
    """
    names, prototypes = langid.fit(docs.filter(~langid.held_out()))
    least = 0.0
    if names:
        tried = docs.filter(langid.held_out() & F.col("lang").isNotNull() & (F.length("text") >= SCORED_CHARS))
        reached = langid.classify(tried, names, prototypes, keep=[]).agg(F.percentile_approx("score", SCORE_QUANTILE, 10_000)).first()[0]
        least = SCORE_SHARE * (reached or 0.0)
    if not names:  # one language unlike every text: a letter decides
        names, prototypes = ["any"], np.zeros((1, langid.DIMENSIONS), np.float32)
    like = (F.col("score") >= least) | (F.length("text") < SCORED_CHARS)
    return langid.classify(docs, names, prototypes).filter((F.col("lang_pred") != langid.UNKNOWN) & like).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their source's boilerplate lines; a text of nothing else goes."""
    out = linededup.drop_boilerplate(spark, docs, ratio=LINE_RATIO, prior_pages=LINE_PRIOR).filter("dropped = 0 OR dropped < lines")
    return out.withColumn("n_chars", F.when(F.col("dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(spark, docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, in training order; the last use of a source may be cut to its target."""
    uses = mixing.mix(spark, docs)
    return uses.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids."""
    import public_tokenizers

    # a smaller memo than alone: workers of the stages before still hold memory
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo_bytes=24 << 20)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language identification and tokenising have no SQL form; the tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. A stage's own tables, and the one it read, go when its result has been written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as spared:
            out = stage(spark, docs, sf_dir)
            before, path = path, new_folder(spark, name.replace(" ", "-"))
            spared.append(path)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, [before])
    return STAGES[-1][1](spark, docs, sf_dir)

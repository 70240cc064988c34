"""Parent recovery, neighbours, fusion of result lists, reranking (RT-06 to RT-18)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.text import blank_to_null, chunk_number, chunk_prefix
from tarnlake.operators.retrieval import above, by_score, effective_score, renumbered, tokens


def merge_parents(candidates: DataFrame, parents: DataFrame, threshold: int = 2) -> DataFrame:
    """RT-06: a stored parent with enough candidates takes their place, at the first one's rank and with their best score.

    A parent that is not stored leaves its children as they are. RT-08: from the first child on that a reranker scored, children
    add their effective score to the reranked one, those before it to the plain score.
    """
    own = F.coalesce(blank_to_null(F.col("parent_chunk_id")), F.concat(F.lit("\x00"), "chunk_id"))
    family = Window.partitionBy("query_id", own)
    kids = candidates.withColumn("__parent", own).withColumn("__n", F.count("*").over(family)).withColumn("__p", F.min(F.when(F.col("rerank_score").isNotNull(), F.col("rank"))).over(family))
    store = parents.select(F.col("chunk_id").alias("__parent"), F.struct("chunk_id", "parent_chunk_id", "chunk_level", "filename").alias("__new"))
    kids = kids.join(store, "__parent", "left").withColumn("__merge", F.col("__new").isNotNull() & (F.col("__n") >= threshold))
    stay = kids.filter(~F.col("__merge")).select("query_id", "rank", "chunk_id", "parent_chunk_id", "chunk_level", "filename", "score", "rerank_score", "merged_child_count")
    up = kids.filter("__merge").groupBy("query_id", "__parent").agg(F.min("rank").alias("rank"), F.first("__new").alias("new"), *_best_scores(), F.count("*").alias("merged_child_count"))
    up = up.select("query_id", "rank", "new.chunk_id", "new.parent_chunk_id", "new.chunk_level", "new.filename", "score", "rerank_score", "merged_child_count")
    return renumbered(stay.unionByName(up))


def _best_scores() -> list[Column]:
    """RT-08 over rows with ``__p``, the first reranked place of their group."""
    after = F.col("rank") >= F.col("__p")
    return [F.max(F.when(~F.coalesce(after, F.lit(False)), F.col("score"))).alias("score"), F.max(F.when(after, effective_score())).alias("rerank_score")]


def auto_merge(candidates: DataFrame, parents: DataFrame, threshold: int = 2) -> DataFrame:
    """RT-07: leaves to their parents, those to theirs."""
    ready = candidates if "merged_child_count" in candidates.columns else candidates.withColumn("merged_child_count", F.lit(None).cast("long"))
    return merge_parents(merge_parents(ready, parents, threshold), parents, threshold)


def auto_merge_meta(candidates: DataFrame, parents: DataFrame, threshold: int = 2) -> DataFrame:
    """RT-07: per query how many candidates were merged (first children included) and in how many steps."""
    zero = candidates.withColumn("merged_child_count", F.lit(None).cast("long"))
    one = merge_parents(zero, parents, threshold)
    two = merge_parents(one, parents, threshold)
    size = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    new = lambda after, before: after.join(before.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").groupBy("query_id").agg(F.sum("merged_child_count").alias("gone"))
    out = size(candidates, "pre").join(size(two, "post"), "query_id").join(new(one, zero).withColumnRenamed("gone", "g1"), "query_id", "left").join(new(two, one).withColumnRenamed("gone", "g2"), "query_id", "left")
    g1, g2 = F.coalesce("g1", F.lit(0)), F.coalesce("g2", F.lit(0))
    return out.select("query_id", "pre", "post", (g1 + g2).alias("replaced"), ((g1 > 0).cast("int") + (g2 > 0).cast("int")).alias("steps"))


def neighbours(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """RT-13: leaves before and after each leaf candidate that exist and are not candidates; ``origins`` names who asked."""
    leaf = candidates.filter("chunk_level IS NULL OR chunk_level = 3").withColumn("__n", chunk_number(F.trim("chunk_id"))).filter("__n IS NOT NULL")
    asked = leaf.select("query_id", "rank", F.trim("chunk_id").alias("from_id"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), "__n").filter("__n + side >= 0")
    asked = asked.withColumn("chunk_id", F.concat(chunk_prefix(F.col("from_id")), (F.col("__n") + F.col("side")).cast("string")))
    each = asked.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "side")).alias("first"), F.sort_array(F.collect_list(F.struct("rank", F.col("from_id").alias("adjacent_to_chunk_id"), F.when(F.col("side") < 0, "previous").otherwise("next").alias("relative_position")))).alias("asks"))
    new = each.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return new.join(chunks.select("chunk_id", "parent_chunk_id", "chunk_level", "filename"), "chunk_id")


def expand_neighbours(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """RT-13: originals, then new neighbours in the order they were asked for, without a score."""
    new = neighbours(candidates, chunks)
    last = candidates.groupBy("query_id").agg(F.max("rank").alias("last"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    added = new.join(last, "query_id").select("query_id", (F.col("last") + place).alias("rank"), "chunk_id", "parent_chunk_id", "chunk_level", "filename", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("rerank_score"), F.lit(True).alias("adjacent_added"))
    return candidates.select("query_id", "rank", "chunk_id", "parent_chunk_id", "chunk_level", "filename", "score", "rerank_score", F.lit(False).alias("adjacent_added")).unionByName(added)


def neighbour_meta(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """RT-13: requested, already present, added, skips by reason, and why the expansion was less than whole.

    A candidate's id is looked at before its level: one whose id is no leaf's is unparseable whatever its level.
    """
    number = chunk_number(F.trim("chunk_id"))
    is_leaf = F.expr("chunk_level IS NULL OR chunk_level = 3")
    bad = number.isNull()
    skips = candidates.groupBy("query_id").agg(F.count_if(bad).alias("unparseable"), F.count_if(~bad & ~is_leaf).alias("not_leaf"))
    asked = candidates.filter(is_leaf).withColumn("__n", number).filter("__n IS NOT NULL").select("query_id", "chunk_id", "__n", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).filter("__n + side >= 0")
    ids = asked.select("query_id", F.concat(chunk_prefix(F.trim("chunk_id")), (F.col("__n") + F.col("side")).cast("string")).alias("chunk_id")).distinct()
    present = ids.join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("present"))
    added = neighbours(candidates, chunks).groupBy("query_id").agg(F.count("*").alias("added"))
    out = skips.join(ids.groupBy("query_id").agg(F.count("*").alias("requested")), "query_id", "left").join(present, "query_id", "left").join(added, "query_id", "left")
    out = out.na.fill(0, ["requested", "present", "added"])
    why = F.when(F.col("requested") == 0, "no_parseable_l3_candidates").when(F.col("unparseable") + F.col("not_leaf") > 0, "unparseable_l3_candidates_skipped")
    return out.withColumn("fallback_reason", why)


def neighbour_skips(candidates: DataFrame) -> DataFrame:
    """RT-13: candidates that ask for no neighbours, with the reason."""
    bad = chunk_number(F.trim("chunk_id")).isNull()
    why = F.when(bad, "unparseable_l3_chunk_id").when(F.expr("chunk_level IS NOT NULL AND chunk_level <> 3"), "candidate_not_l3")
    return candidates.select("query_id", F.col("rank").alias("candidate_index"), why.alias("reason")).filter("reason IS NOT NULL")


def candidate_key(candidates: DataFrame) -> Column:
    """RT-12: the chunk id; without one the file, page and text, as far as there are such columns."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None")) if c in candidates.columns else F.lit("None")
    return F.coalesce(blank_to_null(F.col("chunk_id")), F.concat_ws("|", told("filename"), told("page_number"), told("text")))


def deduplicate(candidates: DataFrame) -> DataFrame:
    """RT-12: one candidate per key, at its first position with the first one's columns and the best scores.

    RT-08: once one of them was reranked, the others' effective scores count there; the first keeps its plain score.
    """
    rest = [c for c in candidates.columns if c not in ("query_id", "rank", "score", "rerank_score")]
    has = [c for c in ("score", "rerank_score") if c in candidates.columns]
    full = candidates if "rerank_score" in has else candidates.withColumn("rerank_score", F.lit(None).cast("double"))
    full = full if "score" in has else full.withColumn("score", F.lit(None).cast("double"))
    same = Window.partitionBy("query_id", "__key")
    keyed = full.withColumn("__key", candidate_key(candidates)).withColumn("__p", F.min(F.when(F.col("rerank_score").isNotNull(), F.col("rank"))).over(same))
    score, reranked = _best_scores()
    best = keyed.groupBy("query_id", "__key").agg(F.min("rank").alias("rank"), F.min_by(F.struct(*rest), "rank").alias("s"), F.min_by("score", "rank").alias("own"), score, reranked)
    out = renumbered(best.select("query_id", "rank", "s.*", F.greatest("score", "own").alias("score"), "rerank_score"))
    return out.select(*candidates.columns)


def fuse_rewrites(initial: DataFrame, rewritten: DataFrame) -> DataFrame:
    """RT-14: both recall lists in order, one row per chunk with its sources (RT-15)."""
    both = initial.select("query_id", "chunk_id", "score", F.struct(F.lit(0).alias("list"), "rank").alias("at"), F.lit("initial").alias("source")).unionByName(rewritten.select("query_id", "chunk_id", "score", F.struct(F.lit(1).alias("list"), "rank").alias("at"), F.lit("rewritten").alias("source")))
    one = both.groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"), F.max("score").alias("score"), F.sort_array(F.collect_set("source")).alias("rewrite_sources"))
    out = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    return out.select("query_id", "rank", "chunk_id", "score", source_label().alias("label"))


def source_label():
    """RT-15."""
    s = F.col("rewrite_sources")
    return F.when(F.array_contains(s, "initial") & F.array_contains(s, "rewritten"), "both").when(F.array_contains(s, "initial"), "initial").when(F.array_contains(s, "rewritten"), "rewritten").otherwise("unknown")


def fuse_or_keep(initial: DataFrame, rewritten: DataFrame) -> DataFrame:
    """RT-16: queries whose second recall found nothing keep the initial list, with the reason."""
    has = rewritten.select("query_id").distinct()
    fused = fuse_rewrites(initial.join(has, "query_id", "left_semi"), rewritten).select("query_id", "rank", "chunk_id", "score", F.lit(None).cast("string").alias("fallback_reason"))
    kept = initial.join(has, "query_id", "left_anti").select("query_id", "rank", "chunk_id", "score", F.lit("no_rewritten_candidates").alias("fallback_reason"))
    return fused.unionByName(kept)


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """Stand-in reranker (UD-02): share of common tokens among all of both texts. ``pairs``: query_id, rank, question, text."""
    a, b = F.array_distinct(tokens(F.col("question"))), F.array_distinct(tokens(F.col("text")))
    return pairs.select("query_id", "rank", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)), 6).alias("rerank_score"))


def rerank(candidates: DataFrame, questions: DataFrame, texts: DataFrame, k: int, scorer: Callable[[DataFrame], DataFrame] = overlap_scorer) -> DataFrame:
    """RT-10: keeps the position as ``rrf_rank``, scores, sorts; candidates the scorer leaves out drop, queries it leaves out keep RT-09's order.

    ``texts`` (chunk_id, text) are fetched for candidates only.
    """
    ready = candidates.drop("rerank_score").withColumn("rrf_rank", F.col("rank"))
    pairs = ready.join(questions.select("query_id", F.col("text").alias("question")), "query_id").join(texts.select("chunk_id", "text"), "chunk_id")
    scores = scorer(pairs)
    done = scores.select("query_id").distinct()
    good = ready.join(scores, ["query_id", "rank"])
    good = good.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rrf_rank")))
    rest = by_score(ready.join(done, "query_id", "left_anti").withColumn("rerank_score", F.lit(None).cast("double")))
    return good.unionByName(rest.select(good.columns)).filter(F.col("rank") <= k)


def finalise(candidates: DataFrame, parents: DataFrame, questions: DataFrame, texts: DataFrame, k: int, least: float, threshold: int = 2) -> DataFrame:
    """RT-11: merge, rerank, threshold, in this order."""
    merged = auto_merge(candidates, parents, threshold)
    return renumbered(above(rerank(merged, questions, texts, k), least))


def finalise_meta(candidates: DataFrame, final: DataFrame) -> DataFrame:
    """RT-11: one row per query."""
    size = candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    done = final.groupBy("query_id").agg(F.count("*").alias("final_count"), F.max(effective_score()).alias("best_score"))
    return size.join(done, "query_id", "left").na.fill(0, ["final_count"])


def stages(**tables: DataFrame) -> DataFrame:
    """RT-17: one long table ``query_id, stage, rank, chunk_id`` of the lists after each step."""
    out = None
    for name, df in tables.items():
        part = df.select("query_id", F.lit(name).alias("stage"), F.col("rank").cast("int").alias("rank"), "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """RT-17: candidates that a step did not return, renumbered."""
    return renumbered(before.join(after.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))

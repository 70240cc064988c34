"""Decisions on questions and evidence as column expressions (DC-01 to DC-11, FL-05, FL-08, RT-18, SM-08).

Statuses that callers see: answerable, partial, needs_rewrite, needs_clarification, needs_scope_selection, no_knowledge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.text import CONTEXT_JOINT, context_entry
from tarnlake.operators.merging import deduplicate

# Words and sentences that results must agree on.
SIMPLE_MARKERS = ("是什么", "是谁", "哪里", "何时", "多少", "是否", "哪个", "哪种", "属性", "参数", "规格", "定义", "含义", "what is", "who is", "where is", "when is", "how many", "which")
COMPLEX_MARKERS = ("比较", "对比", "区别", "差异", "优缺点", "优势", "劣势", "分析", "总结", "综合", "原因", "成因", "影响", "方案", "步骤", "如何", "为什么", "以及", "同时", "并且", "和", "与", "谁更", "compare", "versus", "difference", "different", "analyze", "summarize", "trade-off", "pros and cons", "why ", "how ", "complex")
DIMENSION_MARKERS = ("属性", "武器", "定位", "技能", "机制", "参数", "规格", "性能", "价格", "优点", "缺点", "作用")
ASK_SCOPE = "我在知识库中找到了多个可能相关的方向。你想问的是哪一个？"
ASK_SLOTS = "我找到了相关内容，但还缺少关键信息："
ASK_MORE = "我找到了相关内容，但证据不足以确定答案。请补充一下你具体想问的条件。"
TOOL_CLARIFY = "I found related knowledge, but need one more detail before answering."
TOOL_SCOPE = "I found multiple related knowledge-base directions. Ask the user to choose one."
TOOL_NOTHING = "NO_KNOWLEDGE: No reliable relevant documents were found in the knowledge base."
TOOL_EMPTY = "No relevant documents found in the knowledge base."
#: FL-08, in the order in which they are given out.
TRACE_FIELDS = (
    "retrieval_pipeline", "retrieval_mode", "candidate_k", "candidate_k_source", "candidate_k_config_error", "retrieval_candidate_multiplier", "retrieval_top_k", "leaf_retrieve_level",
    "recall_count", "post_merge_candidate_count", "candidate_count", "auto_merge_enabled", "auto_merge_applied", "auto_merge_threshold", "auto_merge_replaced_chunks", "auto_merge_steps",
    "rerank_enabled", "rerank_applied", "rerank_model", "rerank_endpoint", "rerank_error", "rerank_elapsed_seconds", "rerank_timeout_seconds", "rerank_min_score", "post_rerank_count", "post_threshold_count",
    "retrieval_empty", "retrieval_error", "rewrite_candidate_fusion_enabled", "rewrite_candidate_fusion_applied", "rewrite_candidate_fusion_initial_candidate_count",
    "rewrite_candidate_fusion_rewritten_candidate_count", "rewrite_candidate_fusion_deduplicated_candidate_count", "rewrite_candidate_fusion_fused_candidate_count",
    "rewrite_candidate_fusion_final_document_sources", "rewrite_candidate_fusion_fallback_reason", "adjacent_l3_expansion_enabled", "adjacent_l3_expansion_applied",
    "adjacent_l3_expansion_original_candidate_count", "adjacent_l3_expansion_requested_neighbor_count", "adjacent_l3_expansion_retrieved_neighbor_count", "adjacent_l3_expansion_added_candidate_count",
    "adjacent_l3_expansion_deduplicated_candidate_count", "adjacent_l3_expansion_skipped_candidate_count", "adjacent_l3_expansion_fallback_reason",
)

#: What a grader says about a question's evidence.
GRADE = "struct<relevance: string, answerability: string, ambiguity: string, route: string, confidence: double, reason: string, missing_slots: array<string>, hitl_prompt: string, hitl_options: array<string>>"


def _grade(relevance: str, confidence: float, reason: str) -> Column:
    none = F.lit("none")
    return F.struct(F.lit(relevance), none, none, F.lit("no_knowledge"), F.lit(confidence), F.lit(reason), F.array().cast("array<string>"), F.lit(""), F.array().cast("array<string>")).cast(GRADE)


def no_documents_grade() -> Column:
    """DC-03: nothing was found, and that is certain."""
    return _grade("none", 1.0, "no_retrieved_documents")


def unavailable_grade() -> Column:
    """DC-03: evidence that could not be graded is not answered from."""
    return _grade("weak", 0.0, "evidence_grading_unavailable")


def grade_or_fallback(has_docs: Column, grade: Column) -> Column:
    """DC-03: a grader's ``grade`` (null: it failed) where there is something to grade."""
    return F.when(~has_docs, no_documents_grade()).otherwise(F.coalesce(grade, unavailable_grade()))


def route(has_docs: Column, relevance: Column, answerability: Column, ambiguity: Column, wished: Column, sub_agent: Column, rewrites: Column) -> Column:
    """DC-01: the first rule that holds decides."""
    can_rewrite = rewrites < 1
    return (
        F.when(~has_docs | (relevance == "none"), "no_knowledge")
        .when(ambiguity == "missing_slot", "clarify")
        .when(ambiguity == "multiple_candidates", "scope_select")
        .when((wished == "answer") & (relevance == "strong") & (answerability == "sufficient"), "answer")
        .when(sub_agent, F.when(answerability.isin("partial", "sufficient"), "answer").otherwise("no_knowledge"))
        .when((wished == "rewrite") & can_rewrite, "rewrite")
        .when(wished == "rewrite", F.when(answerability == "partial", "clarify").otherwise("no_knowledge"))
        .when(answerability == "partial", F.when(can_rewrite, "rewrite").otherwise("clarify"))
        .when((relevance == "strong") & (answerability == "sufficient"), "answer")
        .otherwise("no_knowledge")
    )


def status(route: Column, answerability: Column) -> Column:
    """DC-02: what a caller sees."""
    return F.when((route == "answer") & (answerability == "partial"), "partial").when(route == "answer", "answerable").when(route == "rewrite", "needs_rewrite").when(route == "clarify", "needs_clarification").when(route == "scope_select", "needs_scope_selection").otherwise("no_knowledge")


def follow_up_prompt(route: Column, grade: Column) -> Column:
    """DC-04: what a person is asked; empty unless the route asks."""
    slots = grade["missing_slots"]
    default = F.when(route == "scope_select", ASK_SCOPE).when(F.size(slots) > 0, F.concat(F.lit(ASK_SLOTS), F.array_join(slots, "、"))).otherwise(ASK_MORE)
    return F.when(route.isin("clarify", "scope_select"), F.coalesce(F.nullif(grade["hitl_prompt"], F.lit("")), default)).otherwise("")


def grade_update(asked: DataFrame) -> DataFrame:
    """DC-04: ``asked`` has docs (array), context, grade (:data:`GRADE`, null: the grader failed), sub_agent and rewrites.

    Adds the route, what the trace shows of the grade, and what is carried on: documents and context go unless the question is
    answered or asked anew; chunks shown in the trace go where a person is asked.
    """
    has = F.coalesce(F.size("docs") > 0, F.lit(False))
    out = asked.withColumn("grade", grade_or_fallback(has, F.col("grade")))
    g = F.col("grade")
    out = out.withColumn("route", route(has, g["relevance"], g["answerability"], g["ambiguity"], g["route"], F.coalesce("sub_agent", F.lit(False)), F.coalesce("rewrites", F.lit(0))))
    r = F.col("route")
    shown = F.when(r.isin("clarify", "scope_select"), F.slice("docs", 1, 0)).otherwise(F.col("docs"))
    out = out.withColumn("retrieval_status", status(r, g["answerability"])).withColumn("hitl_prompt", follow_up_prompt(r, g)).withColumn("retrieved_chunks", shown)
    for name in ("relevance", "answerability", "ambiguity", "confidence", "reason"):
        out = out.withColumn(f"evidence_{name}", g[name])
    out = out.withColumn("missing_slots", g["missing_slots"]).withColumn("hitl_options", g["hitl_options"])
    return out.withColumn("docs", F.when(keeps_documents(r), F.col("docs")).otherwise(F.slice("docs", 1, 0))).withColumn("context", F.when(keeps_documents(r), F.col("context")).otherwise("")).drop("grade")


def keeps_documents(route: Column) -> Column:
    """DC-04: results without an answer carry no documents on."""
    return ~route.isin("no_knowledge", "clarify", "scope_select")


def normalised_question(question: Column) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(question, F.lit("")), r"[\t-\r\x1c-\x20\x{85}\p{Z}]+", " "), F.lit(" ")))


def simple_reason(question: Column) -> Column:
    """DC-05: why a question may skip the planner, or null."""
    q = normalised_question(question)
    number = lambda words: sum((F.contains(q, F.lit(w)).cast("int") for w in words), F.lit(0))
    spaces = F.length(q) - F.length(F.replace(q, F.lit(" "), F.lit("")))
    asks = F.regexp_count(q, F.lit("[?？;；]"))
    complicated = (q == "") | (F.length(q) > 48) | (number(COMPLEX_MARKERS) > 0) | F.contains(q, F.lit("、")) | (q.rlike(r"[\x{4e00}-\x{9fff}]") & (spaces >= 2)) | (number(DIMENSION_MARKERS) >= 2) | (asks > 1)
    bare = F.regexp_replace(q, "[?？。.!！]+$", "")
    return F.when(complicated, None).when(number(SIMPLE_MARKERS) > 0, "obvious_simple_fast_path:single_fact_marker").when(F.length(bare) <= 18, "obvious_simple_fast_path:short_single_intent")


def needs_person(status: Column) -> Column:
    """DC-06."""
    return status.isin("needs_clarification", "needs_scope_selection")


def refined_question(question: Column, reply: Column) -> Column:
    """DC-06: the person's reply before the question, unless the question holds it already."""
    q, a = F.coalesce(question, F.lit("")), F.regexp_replace(F.coalesce(reply, F.lit("")), r"^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$", "")
    return F.when(q == "", a).when((a == "") | F.contains(q, a), q).otherwise(F.concat(a, F.lit("："), q))


def follow_up_allowed(adjacent_run: Column) -> Column:
    """DC-08: runs that expand neighbours neither rewrite nor split questions."""
    return ~F.coalesce(adjacent_run, F.lit(False))


def usable_branches(branches: DataFrame) -> DataFrame:
    """FL-05: sub-results whose evidence goes into the answer."""
    return branches.filter(F.col("status").isin("answerable", "partial"))


def synthesised_documents(branches: DataFrame, documents: DataFrame) -> DataFrame:
    """RT-18: documents of usable branches in branch order, one per key (RT-12), numbered anew.

    ``branches``: query_id, branch, status. ``documents``: candidates with query_id, branch, rank.
    """
    used = documents.join(usable_branches(branches).select("query_id", "branch"), ["query_id", "branch"], "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("branch", "rank"))
    return deduplicate(used.withColumn("rank", place).drop("branch"))


def synthesis(branches: DataFrame, documents: DataFrame) -> DataFrame:
    """DC-07: one row per query from its branches (query_id, branch, status, hitl_prompt, hitl_options) and their documents.

    With documents the result is partial if any branch is, else answerable. Without any, a branch that asks a person makes the
    query ask: scope selection before clarification, all prompts and options in branch order without repeats.
    """
    merged = documents.join(usable_branches(branches).select("query_id", "branch"), ["query_id", "branch"], "left_semi").groupBy("query_id").agg(F.count("*").alias("merged_count"))
    held = synthesised_documents(branches, documents).groupBy("query_id").agg(F.count("*").alias("docs"))
    asks = F.col("status").isin("needs_clarification", "needs_scope_selection")
    told = F.struct("branch", "status", F.coalesce("hitl_prompt", F.lit("")).alias("prompt"), F.coalesce("hitl_options", F.array().cast("array<string>")).alias("options"))
    one = branches.groupBy("query_id").agg(F.count("*").alias("sub_agent_count"), F.bool_or(F.col("status") == "partial").alias("partial"), F.sort_array(F.collect_list(F.when(asks, told))).alias("asked"))
    one = one.join(held, "query_id", "left").join(merged, "query_id", "left").na.fill(0, ["docs", "merged_count"])
    has, asked = F.col("docs") > 0, F.col("asked")
    scope = F.exists(asked, lambda s: s["status"] == "needs_scope_selection")
    asking = ~has & (F.size(asked) > 0)
    out = F.when(has, F.when(F.col("partial"), "partial").otherwise("answerable")).when(asking, F.when(scope, "needs_scope_selection").otherwise("needs_clarification")).otherwise("no_knowledge")
    prompts = F.array_join(F.array_distinct(F.filter(F.transform(asked, lambda s: s["prompt"]), lambda p: p != "")), "；")
    options = F.array_distinct(F.flatten(F.transform(asked, lambda s: s["options"])))
    return one.select(
        "query_id", "docs", "merged_count", "sub_agent_count", out.alias("status"),
        F.when(has, "answer").when(asking, F.when(scope, "scope_select").otherwise("clarify")).otherwise("no_knowledge").alias("route"),
        F.when(has, "strong").otherwise("none").alias("evidence_relevance"),
        F.when(has, F.when(F.col("partial"), "partial").otherwise("sufficient")).otherwise("none").alias("evidence_answerability"),
        F.when(asking, prompts).otherwise("").alias("hitl_prompt"),
        F.when(asking, options).otherwise(F.array().cast("array<string>")).alias("hitl_options"),
    )


def tool_output(status: Column, route: Column, context: Column, prompt: Column, options: Column) -> Column:
    """DC-09: what an agent reads: a marker with a question for the person, a refusal, or the chunks."""
    chosen = F.when(F.coalesce(F.size(options) > 0, F.lit(False)), F.concat(F.lit("\nOptions: "), F.array_join(options, "; "))).otherwise("")
    says = lambda s, r: F.coalesce(status == s, F.lit(False)) | F.coalesce(route == r, F.lit(False))
    given = lambda default: F.coalesce(F.nullif(prompt, F.lit("")), F.lit(default))
    return (
        F.when(says("needs_clarification", "clarify"), F.concat(F.lit("NEEDS_CLARIFICATION: "), given(TOOL_CLARIFY)))
        .when(says("needs_scope_selection", "scope_select"), F.concat(F.lit("NEEDS_SCOPE_SELECTION: "), given(TOOL_SCOPE), chosen))
        .when(says("no_knowledge", "no_knowledge"), TOOL_NOTHING)
        .when(F.coalesce(context, F.lit("")) == "", TOOL_EMPTY)
        .otherwise(F.concat(F.lit("Retrieved Chunks:\n"), context))
    )


def context_of(candidates: DataFrame) -> DataFrame:
    """TX-24: one context string per query from ``rank, filename, page_number, text``."""
    entry = context_entry(F.col("rank"), F.col("filename"), F.col("page_number"), F.col("text"))
    return candidates.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))), lambda s: s["e"]), CONTEXT_JOINT).alias("context"))


def confidence_percent(confidence: Column) -> Column:
    """DC-10: values up to 1 are shares, others percent; rounded half up and held within 0 and 100."""
    c = F.when(~F.isnan(confidence), confidence)
    return F.when(c.isNotNull(), F.least(F.greatest(F.floor(F.when(c <= 1, c * 100).otherwise(c) + 0.5), F.lit(0)), F.lit(100)).cast("int"))


def confidence_bucket(confidence: Column) -> Column:
    """DC-10."""
    percent = confidence_percent(confidence)
    return F.when(percent.isNull(), "unknown").when(percent >= 85, "high").when(percent >= 60, "medium").otherwise("low")


def funnel_label(recalled: Column, merged: Column, reranked: Column, top_k: Column, returned: Column) -> Column:
    """DC-11: sizes along the way, a dash for an unknown one; null if nothing of the way is known."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("—"))
    label = F.concat(shown(recalled), F.lit(" → "), shown(merged), F.lit(" → "), shown(reranked), F.lit(" → top"), F.coalesce(top_k, returned).cast("string"), F.lit(" ("), returned.cast("string"), F.lit(")"))
    return F.when(recalled.isNotNull() | merged.isNotNull() | reranked.isNotNull(), label)


def trace_fields(meta: Column) -> Column:
    """FL-08: of a map of diagnostics those that may be shown, without nulls, as JSON in their fixed order."""
    held = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.try_element_at(meta, F.lit(n)).alias("value")) for n in TRACE_FIELDS]), lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(held))


def pause(results: DataFrame) -> DataFrame:
    """SM-08: the questions that wait for a person: what a resumed run needs, and no more.

    ``results``: session_id, question, route, status, hitl_prompt, hitl_options, rewrites, complexity, complexity_reason,
    sub_questions, answers (earlier replies; may be null).
    """
    waiting = results.filter(needs_person(F.col("status")) | F.col("route").isin("clarify", "scope_select"))
    scope = (F.col("route") == "scope_select") | (F.col("status") == "needs_scope_selection")
    route_ = F.when(F.coalesce(scope, F.lit(False)), "scope_select").otherwise("clarify")
    return waiting.select(
        "session_id", F.col("question").alias("original_question"), route_.alias("route"), F.when(route_ == "scope_select", "needs_scope_selection").otherwise("needs_clarification").alias("status"),
        F.coalesce("hitl_prompt", F.lit("")).alias("prompt"), F.coalesce("hitl_options", F.array().cast("array<string>")).alias("options"), F.coalesce("rewrites", F.lit(0)).alias("rewrites"),
        "complexity", "complexity_reason", "sub_questions", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"),
    )


def resume(pending: DataFrame, replies: DataFrame) -> DataFrame:
    """SM-08: paused questions with a person's reply (session_id, reply), ready to be searched again.

    The rewrite budget goes on where it stopped; neither the complexity nor the sub-questions are worked out anew. A blank reply
    searches the old question once more.
    """
    reply = F.btrim("reply")
    got = pending.join(replies.filter("reply IS NOT NULL"), "session_id")
    return got.select(
        "session_id", refined_question(F.col("original_question"), F.col("reply")).alias("query"), "rewrites", "complexity", "complexity_reason", "sub_questions", F.array_append("answers", reply).alias("answers"),
        F.lit(True).alias("hitl_resumed"), F.col("reply").alias("hitl_answer"), F.col("status").alias("hitl_resume_from_status"), F.col("route").alias("hitl_resume_from_route"),
    )

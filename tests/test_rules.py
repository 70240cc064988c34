"""Rules of routing, evaluation and naming on rows decided by hand."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import models, split
from tarnlake.functions import text as T
from tarnlake.operators import evaluate, inverted, merging, retrieval, routing, sampling, sessions, tables, translation

GRADE = routing.GRADE


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def asked(spark, rows):
    """(docs, grade or None, sub_agent, rewrites)"""
    return spark.createDataFrame(rows, f"docs array<string>, grade {GRADE}, sub_agent boolean, rewrites int").withColumn("context", F.lit("ctx"))


def test_grades_and_routes(spark):
    g = lambda relevance, answerability, ambiguity="none", wish="answer", slots=(), prompt="": (relevance, answerability, ambiguity, wish, 0.9, "r", list(slots), prompt, ["o"])
    rows = [
        ([], g("strong", "sufficient"), False, 0), (["d"], None, False, 0), (["d"], g("strong", "sufficient"), False, 0), (["d"], g("strong", "partial"), False, 0), (["d"], g("strong", "partial"), False, 1),
        (["d"], g("weak", "partial", wish="rewrite"), False, 1), (["d"], g("weak", "none", wish="rewrite"), False, 1), (["d"], g("weak", "partial"), True, 0), (["d"], g("strong", "sufficient", "multiple_candidates"), False, 0),
        (["d"], g("strong", "sufficient", "missing_slot", slots=["year", "plan"]), False, 0), (["d"], g("strong", "sufficient", "missing_slot", prompt="which?"), False, 0), (None, None, None, None), (["d"], g("strong", "sufficient", wish="clarify"), False, 0),
    ]
    out = routing.grade_update(asked(spark, rows)).collect()
    assert [(r.route, r.retrieval_status) for r in out] == [
        ("no_knowledge", "no_knowledge"), ("no_knowledge", "no_knowledge"), ("answer", "answerable"), ("rewrite", "needs_rewrite"), ("clarify", "needs_clarification"), ("clarify", "needs_clarification"), ("no_knowledge", "no_knowledge"),
        ("answer", "partial"), ("scope_select", "needs_scope_selection"), ("clarify", "needs_clarification"), ("clarify", "needs_clarification"), ("no_knowledge", "no_knowledge"), ("answer", "answerable"),
    ]
    assert [(r.evidence_reason, r.evidence_confidence, r.evidence_relevance) for r in out[:2]] == [("no_retrieved_documents", 1.0, "none"), ("evidence_grading_unavailable", 0.0, "weak")]
    assert [r.hitl_prompt for r in out[8:11]] == ["我在知识库中找到了多个可能相关的方向。你想问的是哪一个？", "我找到了相关内容，但还缺少关键信息：year、plan", "which?"] and out[4].hitl_prompt.startswith("我找到了相关内容，但证据不足")
    assert [(r.docs, r.context) for r in out[1:5]] == [([], ""), (["d"], "ctx"), (["d"], "ctx"), ([], "")] and out[1].retrieved_chunks == ["d"] and out[8].retrieved_chunks == []


def test_synthesis(spark):
    b = spark.createDataFrame([(1, 0, "answerable", "", []), (1, 1, "partial", "", []), (2, 0, "needs_clarification", "a?", ["x"]), (2, 1, "needs_scope_selection", "b?", ["y", "x"]), (2, 2, "needs_clarification", "a?", None), (3, 0, "no_knowledge", None, None), (4, 0, "answerable", "", []), (4, 1, "needs_clarification", "q", []), (5, 0, "answerable", "", []), (5, 1, "no_knowledge", "", [])], "query_id int, branch int, status string, hitl_prompt string, hitl_options array<string>")
    d = spark.createDataFrame([(1, 0, 1, "c1", 0.1), (1, 1, 1, "c2", 0.2), (1, 1, 2, "c1", 0.9), (3, 0, 1, "c9", 1.0), (5, 0, 1, "c1", 0.5)], "query_id int, branch int, rank int, chunk_id string, score double").withColumn("filename", F.lit("f"))
    out = {r.query_id: r for r in routing.synthesis(b, d).collect()}
    assert {i: (r.status, r.route, r.docs, r.merged_count) for i, r in out.items()} == {1: ("partial", "answer", 2, 3), 2: ("needs_scope_selection", "scope_select", 0, 0), 3: ("no_knowledge", "no_knowledge", 0, 0), 4: ("needs_clarification", "clarify", 0, 0), 5: ("answerable", "answer", 1, 1)}
    assert out[2].hitl_prompt == "a?；b?" and out[2].hitl_options == ["x", "y"] and out[1].evidence_answerability == "partial" and out[5].evidence_answerability == "sufficient"
    assert [(r.chunk_id, r["rank"], r.score) for r in routing.synthesised_documents(b, d).filter("query_id = 1").orderBy("rank").collect()] == [("c1", 1, 0.9), ("c2", 2, 0.2)]


def test_pause_and_resume(spark):
    runs = spark.createDataFrame([(1, "limit?", "clarify", "needs_clarification", None, None, 1, "complex", "two parts", ["a"], None), (2, "which", "scope_select", None, "pick", ["x"], None, None, None, None, ["old"]), (3, "done", "answer", "answerable", None, None, 0, None, None, None, None)], "session_id int, question string, route string, status string, hitl_prompt string, hitl_options array<string>, rewrites int, complexity string, complexity_reason string, sub_questions array<string>, answers array<string>")
    pending = {r.session_id: r for r in routing.pause(runs).collect()}
    assert set(pending) == {1, 2} and (pending[2].status, pending[2].options, pending[2].rewrites, pending[1].prompt) == ("needs_scope_selection", ["x"], 0, "")
    got = {r.session_id: r for r in routing.resume(routing.pause(runs), spark.createDataFrame([(1, " plan A "), (2, "  "), (9, "x")], "session_id int, reply string")).collect()}
    assert set(got) == {1, 2} and got[2].answers == ["old", ""] and got[2].query == "which"
    assert (got[1].query, got[1].rewrites, got[1].complexity, got[1].sub_questions, got[1].answers, got[1].hitl_resume_from_route) == ("plan A：limit?", 1, "complex", ["a"], ["plan A"], "clarify")


def test_trace_and_funnel(spark):
    meta = F.create_map(*[F.lit(x) for x in ("zzz", "1", "candidate_count", "3", "retrieval_mode", "dense")])
    assert one(spark, routing.trace_fields(meta)).c0 == '{"retrieval_mode":"dense","candidate_count":"3"}'
    n = lambda *a: one(spark, routing.funnel_label(*[F.lit(x).cast("int") for x in a])).c0
    assert n(24, 10, None, 8, 5) == "24 → 10 → — → top8 (5)" and n(None, None, None, 8, 5) is None and n(1, None, None, None, 2) == "1 → — → — → top2 (2)"
    p = lambda c: one(spark, routing.confidence_percent(F.lit(c).cast("double")), routing.confidence_bucket(F.lit(c).cast("double")))
    assert [tuple(p(c)) for c in (0.845, 0.855, 1.0, 84.5, 150.0, -3.0, None, float("nan"), 59.4)] == [(85, "high"), (86, "high"), (100, "high"), (85, "high"), (100, "high"), (0, "low"), (None, "unknown"), (None, "unknown"), (59, "low")]


RESULT = "case_id int, verdict string, evaluation_error string, answer_error string, grader_error string, evidence_reason string, question_type string, refusal_correct boolean, expected array<string>, ranks array<int>, coverage double, case_set string"


def results(spark, rows):
    base = {"verdict": "pass", "evaluation_error": None, "answer_error": None, "grader_error": None, "evidence_reason": None, "question_type": "basic", "refusal_correct": None, "expected": ["a"], "ranks": [1], "coverage": 1.0, "case_set": "analysis"}
    return spark.createDataFrame([tuple(({"case_id": i} | base | r).values()) for i, r in enumerate(rows)], RESULT)


def test_failure_classes(spark):
    rows = [{}, {"ranks": [], "verdict": "fail", "coverage": 0.0}, {"ranks": [4, 9]}, {"ranks": [3]}, {"coverage": 0.5}, {"verdict": "FAIL"}, {"verdict": "fail", "grader_error": "x"}, {"verdict": None}, {"evidence_reason": "evidence_grading_unavailable", "verdict": "review"}, {"question_type": "info_not_found", "expected": [], "ranks": [], "refusal_correct": True}, {"question_type": "info_not_found", "refusal_correct": True, "verdict": "fail"}, {"question_type": "info_not_found", "refusal_correct": None}, {"expected": [], "ranks": None, "coverage": 0.5}, {"evaluation_error": "  "}]
    got = {r.case_id: r.l for r in results(spark, rows).select("case_id", evaluate.failure_labels().alias("l")).collect()}
    assert [got[i] for i in range(len(rows))] == [[], ["retrieval_miss", "answer_failure"], ["retrieval_late"], [], ["evidence_incomplete"], ["answer_failure"], ["system_error"], ["human_review"], ["system_error"], [], ["answer_failure", "refusal_failure"], ["refusal_failure"], [], []]
    counts = evaluate.failure_counts(results(spark, rows)).orderBy("position").collect()
    assert [r.label for r in counts] == list(evaluate.FAILURES) and counts[2].cases == 0 and counts[7].cases == 2
    assert [(r.verdict, r.cases) for r in evaluate.verdict_counts(results(spark, rows)).collect()] == [("FAIL", 1), ("fail", 3), ("pass", 8), ("review", 2)]
    quota = results(spark, [{"evaluation_error": "APIStatusError: Error code: 402 x"}, {"evaluation_error": "your account balance is insufficient"}, {"evaluation_error": "timeout"}, {"answer_error": "y"}, {}]).select(evaluate.quota_spent().alias("q"), evaluate.retryable().alias("r")).collect()
    assert [(r.q, r.r) for r in quota] == [(True, True), (True, True), (False, True), (False, True), (False, False)]


def test_review_queue(spark):
    rows = [{}, {"verdict": "review"}, {"verdict": "fail"}, {"coverage": None}, {"case_set": "validation", "verdict": None}, {"case_set": "validation"}, {"grader_error": "x", "verdict": "fail", "coverage": 0.2}]
    df = results(spark, rows).withColumn("question", F.lit("q"))
    shown = {r.case_id: r.reasons for r in evaluate.review_queue(df, blind=False).collect()}
    assert shown == {1: ["grader_review"], 2: ["evidence_complete_answer_failed"], 3: ["answer_passed_evidence_incomplete"], 4: ["validation_failure"], 6: ["system_error"]}
    hidden = [r for r in evaluate.review_queue(df).collect() if r.redacted]
    assert [(r.case_id, r.question, r.reasons, r.case_set) for r in hidden] == [(None, None, ["validation_case_suppressed"], "validation")]


def test_attribution(spark):
    rows = [("fail", "pass", 0.0, 1.0, False, False), ("fail", "pass", 1.0, 1.0, False, False), ("fail", "fail", 0.0, 0.5, False, False), ("pass", "fail", 1.0, 0.5, False, False), ("pass", "pass", 1.0, 1.0, False, False), ("fail", "pass", 0.0, 1.0, True, True), ("fail", "pass", 0.0, 1.0, True, False), ("review", "pass", 1.0, 0.5, False, False)]
    df = spark.createDataFrame(rows, "before_verdict string, after_verdict string, before_coverage double, after_coverage double, before_system_error boolean, after_system_error boolean")
    got = df.select(evaluate.attribution_label().alias("a"), evaluate.attribution_label(False).alias("b"), evaluate.transition().alias("t")).collect()
    up, still, part, down, none = "evidence_recovered_and_answer_pass_candidate", "answer_pass_without_coverage_gain", "evidence_recovered_but_answer_not_pass", "evidence_coverage_regressed", "no_measurable_evidence_coverage_change"
    assert [r.a for r in got] == [up, still, part, down, none, "system_error", "baseline_system_error_no_comparison", down]
    assert [r.b for r in got] == [up, "answer_pass_without_evidence_coverage_gain", part, down, none, up, up, "answer_pass_without_evidence_coverage_gain"] and got[3].t == "pass_to_fail;coverage_down"


def test_language_policy(spark):
    rows = [(1, "Which?", "complex", ["a", "b"], ["a"]), (2, "Which?", "complex", ["a 表"], ["a"]), (3, "Which?", "complex", [" "], ["a"]), (4, "Which?", "complex", ["a"], None), (5, "Which?", "simple", ["表"], None), (6, "全中文", "complex", ["表"], ["表"])]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows] + [(7, "Which?", "complex", ["表"], None, "down", None, None)], "case_id int, question string, complexity string, sub_questions array<string>, candidate_queries array<string>, evaluation_error string, answer_error string, grader_error string")
    r = evaluate.language_compliance(df).first()
    assert (r.english_cases, r.system_errors, r.checked_cases, r.violations, r.compliant) == (6, 1, 4, 3, False)
    assert {(o.case_id, o.reason) for o in evaluate.language_observations(df).collect() if o.reason} == {(2, "chinese_characters"), (3, "missing_actual_sub_questions"), (4, "missing_actual_retrieval_query")}
    assert evaluate.language_compliance(df.filter("case_id = 1")).first().compliant is True and evaluate.language_compliance(df.filter("case_id > 4")).first().compliant is None


def test_exam_of_nothing(spark):
    none = spark.createDataFrame([], "http_status int, all_recalled boolean, ranks array<int>, verdict string, fact_results array<string>, claims_mentioned array<boolean>, elapsed_s double")
    r = evaluate.exam_summary(none).first()
    assert (r.cases, r.all_expected_docs_recall_rate, r.answer_pass_rate, r.average_elapsed_seconds, r.expected_facts_total) == (0, 0.0, None, 0.0, 0)
    some = spark.createDataFrame([(200, True, [1, 2], "pass", ["met", "missing"], [True], 1.0), (200, False, [2, None], None, ["met"], [], 2.0), (500, True, [1], "pass", ["met"], [True], 3.0005), (200, True, [], "review", [], [], 0.0)], none.schema)
    r = evaluate.exam_summary(some).first()
    assert (r.successful_cases, r.failed_cases, r.first_expected_doc_at_1, r.all_expected_docs_at_2, r.answer_judged_cases, r.expected_facts_met, r.forbidden_claim_violations, r.all_expected_docs_recall_rate, r.answer_pass_rate) == (3, 1, 1, 1, 2, 1, 1, 0.6667, 0.5)


def test_manifests(spark):
    ids = spark.createDataFrame([(f"c{i}", "analysis") for i in range(30)], "case_id string, case_set string")
    r = evaluate.freeze_manifest(ids, ids.limit(0), "rerank_model_comparison").first()
    assert (r.case_count, r.changed_variable, len(r.ids)) == (30, "rerank_model", 30) and r.ids == sorted(r.ids)
    for bad, validation in ((ids.limit(29), ids.limit(0)), (ids.limit(29).union(ids.limit(1)), ids.limit(0)), (ids, ids.limit(1)), (ids.withColumn("case_set", F.when(F.col("case_id") != "c3", F.col("case_set"))), ids.limit(0))):
        with pytest.raises(ValueError, match="contract"):
            evaluate.freeze_manifest(bad, validation, "model_comparison")
    labelled = spark.createDataFrame([("a", "retrieval_miss"), ("a", "evidence_incomplete"), ("b", "other")], "case_id string, label string")
    assert [(r.case_id, r.categories) for r in evaluate.audited_cases(labelled, {"retrieval_miss": 1, "retrieval_late": 0, "evidence_incomplete": 1}).collect()] == [("a", ["evidence_incomplete", "retrieval_miss"])]
    with pytest.raises(Exception, match="another number"):
        evaluate.audited_cases(labelled).collect()


def test_names(spark):
    f = lambda i, t, **k: one(spark, T.stable_filename(F.lit(i), F.lit(t).cast("string"), **k)).c0
    h = lambda i: hashlib.sha256(i.encode()).hexdigest()[:16]
    assert f("a b/1", "The title!") == f"a_b_1__{h('a b/1')}__The_title.md" and f("页", None) == f"document__{h('页')}__untitled.md"
    long = f("i" * 60, "t" * 200)
    assert long == f"{'i' * 40}__{h('i' * 60)}__{'t' * 57}.md" and len(long) == 120 and len(f("i" * 60, "t" * 60, longest=10)) == 40
    r = one(spark, *[T.without_run_prefix(F.lit(x)) for x in ("eval__7__enterprise__dsid_0af.md", "enterprise__dsid_0AF.md", "")], *[T.session_title(F.lit(x)) for x in ("  。Hello\n\tworld！ ", "??", "a" * 20, "，x；")])
    assert list(r) == ["enterprise__dsid_0af.md", "enterprise__dsid_0AF.md", "", "Hello world", "新会话", "a" * 16, "x"]


def test_facts(spark):
    facts = lambda t: sorted(one(spark, T.fact_tokens(F.lit(t))).c0)
    assert facts("Wait 5 Minutes, 1.5GB, v2 and 3 d") == ["literal:1.5gb", "number:1.5", "number:3", "number:5", "time:3day", "time:5minute"]
    assert facts("见 https://a.b/c), `x = 1`。 30 秒 100%") == sorted(["time:30second", "number:30", "number:100", "number:1", "literal:https://a.b/c", "literal:`x = 1`", "literal:100%"])
    pairs = spark.createDataFrame([(1, "5 min and 5 minutes", "5 分钟"), (2, "`a`", "  "), (3, "10 MB", "10mb"), (4, None, "x"), (5, "7 7", "7 7 7")], "id int, source string, target string")
    assert {(r.id, r.fact, r.lost) for r in translation.lost_facts(pairs, "id").collect()} == {(1, "time:5minute", 1), (1, "number:5", 1), (2, "empty_translation", 1)}
    masked, held = split.mask("See https://a.b/c., wait 20 ms or `y 1` (3,5).")
    assert held == {"[[RAG_KEEP_1]]": "https://a.b/c", "[[RAG_KEEP_2]]": "20 ms", "[[RAG_KEEP_3]]": "`y 1`", "[[RAG_KEEP_4]]": "3,5"} and masked == "See [[RAG_KEEP_1]]., wait [[RAG_KEEP_2]] or [[RAG_KEEP_3]] ([[RAG_KEEP_4]])."
    assert split.translation_segments("a\nb\n", 10) == ["a\nb\n"] and split.translation_segments("aa\nbb\ncc\n", 6) == ["aa\nbb\n", "cc\n"] and split.translation_segments("x yyyyyyy zz\nq", 6) == ["x ", "yyyyyy", "y zz\nq"] and split.translation_segments("", 5) == [""]
    key = one(spark, models.translation_key(F.lit("t"), "de", "m", "v")).c0
    assert key == hashlib.sha256("\n".join([hashlib.sha256(b"t").hexdigest(), "de", "m", "v"]).encode()).hexdigest()


def test_formal_split(spark):
    cases = spark.range(500).select(F.col("id"), F.when(F.col("id") < 300, "a").otherwise("b").alias("kind"))
    quotas = {"a": (200, 100), "b": (50, 150)}
    assert {(r.kind, r.split): r["count"] for r in sampling.formal_split(cases, "kind", "id", "7", quotas).groupBy("kind", "split").count().collect()} == {("a", "analysis"): 200, ("a", "validation"): 100, ("b", "analysis"): 50, ("b", "validation"): 150}
    for bad, why in ((cases.filter("id > 0"), "contract"), (cases.withColumn("kind", F.lit("c")), "contract"), (cases.withColumn("id", F.lit(1)), "twice"), (cases.withColumn("kind", F.when(F.col("id") > 3, F.col("kind"))), "without")):
        with pytest.raises(ValueError, match=why):
            sampling.formal_split(bad, "kind", "id", "7", quotas)
    docs = spark.createDataFrame([(i, "s" if i % 2 else None) for i in range(20)], "doc_id int, source string")
    got = sampling.ordinary_ids(docs, docs.filter("doc_id < 4"), "source", "doc_id", 8, "s")
    assert got.count() == 8 and got.filter("doc_id < 4").count() == 0
    with pytest.raises(ValueError, match="wanted"):
        sampling.ordinary_ids(docs, docs.filter("doc_id < 4"), "source", "doc_id", 17, "s")


def test_hard_negatives_of_chained_lists(spark):
    lists = {i: [i, i + 1, i + 2, 90 + i % 3] for i in range(40)} | {100: [500, 501, 502], 101: [500, 501, 502], 102: [502, 7]}
    df = spark.createDataFrame([(c, f"q{c}", k, d) for c, ds in lists.items() for k, d in enumerate(ds, 1)], "case_pos int, case_id string, rank int, doc int")
    used, want = {3, 500}, set()
    for c in sorted(lists):
        got = [d for d in lists[c] if d not in used][:2]
        used |= set(got)
        want |= {(f"q{c}", d) for d in got}
    out = sampling.hard_negatives(df, excluded=spark.createDataFrame([(3,), (500,)], "doc int")).collect()
    assert {(r.case_id, r.doc) for r in out} == want


def test_located_leaves(spark):
    sources = spark.createDataFrame([("f", "aa bb aa cc"), ("g", None)], "filename string, text string")
    leaf = spark.createDataFrame([("f", "1", 0, "aa"), ("f", "2", 1, "bb"), ("f", "3", 2, "aa"), ("f", "4", 3, "zz"), ("f", "5", 4, "aa bb"), ("g", "6", 0, "x"), ("h", "7", 0, "aa")], "filename string, chunk_id string, leaf_index int, text string")
    assert {r.chunk_id: (r.start, r.end) for r in tables.located(leaf, sources).collect()} == {"1": (0, 2), "2": (3, 5), "3": (6, 8), "4": (-1, -1), "5": (0, 5), "6": (-1, -1), "7": (-1, -1)}


def test_target_manifest(spark):
    reviews = spark.createDataFrame([(1, "d1"), (2, "d2")], "case_id int, source_ref string")
    docs = spark.createDataFrame([("d1", "f1", "h1"), ("d2", "f2", "h2")], "doc_id string, stable_filename string, markdown_hash string")
    cases = spark.createDataFrame([(1, ["d0", "d1"]), (2, None)], "case_id int, expected_doc_ids array<string>")
    before = spark.createDataFrame([(1, 0.5, "fail"), (2, None, None)], "case_id int, coverage double, verdict string")
    got = {r.case_id: (r.expected_document_ids, r.baseline_coverage) for r in tables.target_manifest(reviews, docs, cases, before).collect()}
    assert got == {1: (["d0", "d1"], 0.5), 2: (["d2"], None)}
    with pytest.raises(Exception, match="case or baseline record for 2"):
        tables.target_manifest(reviews, docs, cases, before.limit(1)).collect()


def test_runs_counts_and_checkpoints(spark, tmp_path):
    runs = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", None)], "chunk_id string, corpus_run_id string")
    assert sorted(r.chunk_id for r in tables.without_run(runs, "r1").collect()) == ["b", "c"]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("", 1, "z")], "chunk_id string, version int, body string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 1, "n"), (None, 9, "n")], old.schema)
    assert {(r.chunk_id, r.body) for r in tables.upsert(old, new).collect()} == {("a", "n"), ("b", "y")}
    leaf = spark.createDataFrame([(3,), (3,), (2,)], "chunk_level int")
    tables.verify_count(leaf, 2)
    with pytest.raises(ValueError, match="2 leaves"):
        tables.verify_count(leaf, 3)
    for _ in range(2):
        tables.append_checkpoint(runs, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c").count() == 6


def test_cache_and_notes(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    make = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))
    writes = make([("k", 0, "a"), ("k", 100, "b"), ("k", 900, None), ("e", 0, "")], "key string, ts int, value string")
    reads = make([("k", 0), ("k", 99), ("k", 399), ("k", 400), ("k", 901), ("e", 1), ("n", 1)], "key string, ts int")
    got = {(r.key, int(r.ts.timestamp())): r.value for r in sessions.cache_lookups(writes, reads).collect()}
    assert got == {("k", 0): "a", ("k", 99): "a", ("k", 399): "b", ("k", 400): None, ("k", 901): None, ("e", 1): None, ("n", 1): None}
    assert one(spark, at(1)).c0 is not None
    calls = make([("u", 0, 0, 5.0), ("u", 1, 1, 5.0), ("u", 2, 2, 5.0), ("u", 3, 200, 99.0), ("w", 9, 0, None)], "k string, seq int, ts int, tokens double")
    got = {r.seq: r.waited for r in sessions.paced(calls, "k", 60, 2, 12.0).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 58.0, 3: 0.0, 9: 0.0}
    assert {r.seq: r.waited for r in sessions.paced(calls, "k", 60, 0, 0).collect()} == dict.fromkeys((0, 1, 2, 3, 9), 0.0)


def test_rate_window_without_key(spark):
    calls = spark.createDataFrame([(i, s, float(i)) for i, s in enumerate((0, 10, 59, 60, 61, 120, 121, 500))], "seq int, s int, tokens double").withColumn("ts", F.timestamp_seconds("s"))
    rows = calls.collect()
    for r in sessions.rate_window(calls, None, 60, 3, 9.0).collect():
        held = [c.tokens for c in rows if r.s - 60 <= c.s <= r.s]
        assert (r.window_calls, r.window_tokens) == (len(held), sum(held)) and r.admitted == (len(held) <= 3 and (sum(held) <= 9 or len(held) == 1))


def test_dense_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(2)
    vectors = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("nul", None)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 7)] + [(999, None)], "query_id long, qvec array<double>")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    first = key(retrieval.dense(vectors, asked, 5))
    for i in range(0, 300, 7):
        s = np.round(x @ x[i], 6)
        assert [c for q, _, c, _ in first if q == i] == [f"c{j:03d}" for j in np.lexsort((np.arange(300), -s))[:5]]
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 800)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 70)
    assert key(retrieval.dense(vectors, asked, 5)) == first
    assert retrieval.dense(vectors, asked.limit(0), 5).count() == 0


def test_candidates_without_ids(spark):
    c = spark.createDataFrame([(1, 1, None, "f", 1, "t", 0.1), (1, 2, " ", "f", 1, "t", 0.7), (1, 3, "", "f", 2, "t", 0.2), (1, 4, "x", "g", 1, "u", None)], "query_id int, rank int, chunk_id string, filename string, page_number int, text string, score double")
    assert [(r["rank"], r.filename, r.page_number, r.score) for r in merging.deduplicate(c).orderBy("rank").collect()] == [(1, "f", 1, 0.7), (2, "f", 2, 0.2), (3, "g", 1, None)]


def test_scores_of_merged_candidates(spark):
    schema = "query_id int, rank int, chunk_id string, parent_chunk_id string, chunk_level int, filename string, score double, rerank_score double"
    c = spark.createDataFrame([(1, 1, "a", "p", 3, "f", 0.9, None), (1, 2, "b", "p", 3, "f", 0.2, 0.3), (1, 3, "c", "p", 3, "f", 0.8, None), (2, 1, "a", "p", 3, "f", 0.9, 0.1), (2, 2, "b", "p", 3, "f", None, None), (3, 1, "a", "p", 3, "f", None, None), (3, 2, "b", "p", 3, "f", 0.4, None)], schema)
    parents = spark.createDataFrame([("p", "", 2, "f")], "chunk_id string, parent_chunk_id string, chunk_level int, filename string")
    assert {r.query_id: (r.score, r.rerank_score) for r in merging.auto_merge(c, parents).collect()} == {1: (0.9, 0.8), 2: (None, 0.1), 3: (0.4, None)}
    same = c.withColumn("chunk_id", F.lit("a"))
    assert {r.query_id: (r.score, r.rerank_score) for r in merging.deduplicate(same).collect()} == {1: (0.9, 0.8), 2: (0.9, 0.1), 3: (0.4, None)}


def test_search_by_join_and_in_slices(spark, monkeypatch, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(250)] + [("nul", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, 5))) for i in range(30)] + [(99, "unknown")], "query_id long, text string")
    retrieval.build_index(chunks, f"{tmp_path}/i")
    index = retrieval.open_index(spark, f"{tmp_path}/i")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    want = key(retrieval.bm25(chunks, asked, 7))
    assert key(retrieval.search(index, asked, 7)) == want and len(want) == 30 * 7
    monkeypatch.setattr(inverted, "GROUP_SPANS", 1)
    assert key(retrieval.search(index, asked, 7)) == want
    monkeypatch.setattr(inverted, "BROADCAST_BYTES", 64)
    assert key(retrieval.search(index, asked, 7)) == want
    assert retrieval.search(index, asked.filter("query_id = 99"), 7).count() == 0 and retrieval.search(index, asked.limit(0), 7).count() == 0


def test_medians_are_values_and_refusals_have_their_own_column(spark):
    rows = [(False, None, 1.0, "pass", 1.0), (True, True, None, "fail", 3.0), (True, False, None, "pass", 10.0), (True, None, None, None, 2.0)]
    df = spark.createDataFrame(rows, "refusal boolean, refusal_correct boolean, coverage double, verdict string, total_s double").withColumn("rag_s", F.lit(None).cast("double")).withColumn("answer_s", F.col("total_s"))
    got = evaluate.multihop_metrics(df.withColumn("rewrite", F.lit(True)).withColumn("split", F.lit(None).cast("boolean")).withColumn("merged", F.lit(False))).first()
    assert got.median_total_s == 2.0 and got.median_rag_s == 0.0 and got.refusal_correct == round(1 / 3, 6) and got.split_rate == 0.0


def test_title_query_keeps_case(spark):
    assert spark.range(1).select(T.fts_query(F.lit("Foo foo Foo-Bar")).alias("x")).first().x == '"Foo" OR "foo" OR "Bar"'


def test_title_query_takes_the_whole_question(spark, tmp_path):
    """Tokens after the 64th too, in the query and in its twin."""
    import duckdb

    from tarnlake.plans.catalog import ORACLE_SQL, QUERIES

    words = [f"w{i}" for i in range(500)]
    path = f"{tmp_path}/benchmark.parquet"
    spark.createDataFrame([(1, " ".join(words + words[:9])), (2, ""), (3, None)], "item_id long, text string").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{path}/*.parquet'")
    got = {r.item_id: r.fts for r in QUERIES["fts_query"](spark, str(tmp_path)).collect()}
    assert got[1] == " OR ".join(f'"{w}"' for w in words)
    assert got == dict(c.execute(ORACLE_SQL["fts_query"]).fetchall())


def test_settings_in_columns_are_those_of_the_classes(spark):
    from tarnlake.config import ChunkingConfig, RetrievalConfig
    from tarnlake.operators import chunking

    for size, overlap in ((800, 100), (100, 10), (3000, 900)):
        got = one(spark, chunking.config_hash_of(F.lit(size), F.lit(overlap), F.lit("semantic"))).c0
        assert got == chunking.config_hash(ChunkingConfig(size, overlap), "semantic")
    for k, c in ((8, None), (8, 3), (8, 100), (5, None)):
        assert tuple(one(spark, retrieval.pool_size(F.lit(k), F.lit(c).cast("int"))).c0) == RetrievalConfig(top_k=k, candidate_k=c).pool()


def test_texts_are_sanitized_some_at_a_time(spark):
    import pyarrow as pa

    from tarnlake.operators import chunking

    texts = ["e\u0301\x07" + str(i) for i in range(250)] + [None]
    parts = list(chunking._sanitized(iter([pa.RecordBatch.from_arrays([pa.array(range(251)), pa.array(texts)], ["i", "text"])]), 1))
    assert max(p.num_rows for p in parts) <= 100 and [x for p in parts for x in p.column(1).to_pylist()] == ["\u00e9" + str(i) for i in range(250)] + [None]
    got = chunking.sanitize_column(spark.createDataFrame(list(enumerate([*texts, "plain"])), "i int, text string"))
    assert {(r.i, r.text) for r in got.collect()} == {*((i, "\u00e9" + str(i)) for i in range(250)), (250, None), (251, "plain")}

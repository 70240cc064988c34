"""Operators on hand-made rows: nulls, ties, empty tables and failure modes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.config import RetrievalConfig
from tarnlake.operators import evaluate, merging, retrieval, routing, sampling, sessions, tables
from tarnlake.sources import readers
from tarnlake.streaming import views

CANDIDATE = "query_id int, rank int, chunk_id string, parent_chunk_id string, chunk_level int, filename string, score double, rerank_score double"


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATE)


def test_pool():
    assert RetrievalConfig().pool() == (24, "multiplier") and RetrievalConfig(candidate_k=3).pool() == (8, "explicit")


def test_bm25_ties_and_empty(spark):
    chunks = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", None), ("d", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "X"), (2, None), (3, "zzz")], "query_id int, text string")
    got = retrieval.bm25(chunks, asked, 5).collect()
    assert [(r.query_id, r.rank, r.chunk_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, "a"), (1, 2, "b")]
    assert retrieval.bm25(chunks.limit(0), asked, 5).count() == 0


def test_modes(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, "x", [0.0, 1.0])], "query_id int, text string, qvec array<double>")
    both = retrieval.retrieve("hybrid", chunks, vectors, asked, 2)
    assert {r.chunk_id for r in both.collect()} == {"a", "b"}
    assert both.first().retrieval_error is None
    fallback = retrieval.retrieve("hybrid", chunks, None, asked, 2).collect()
    assert [(r.chunk_id, r.retrieval_mode) for r in fallback] == [("a", "bm25_fallback")] and fallback[0].retrieval_error.startswith("dense: ")
    fallback = retrieval.retrieve("hybrid", chunks.drop("text"), vectors, asked, 1).collect()
    assert [(r.chunk_id, r.retrieval_mode) for r in fallback] == [("b", "dense_fallback")] and fallback[0].retrieval_error.startswith("bm25: ")
    for mode in ("hybrid", "dense"):
        r = retrieval.retrieve(mode, None, None, asked, 2).first()
        assert (r.query_id, r.chunk_id, r.retrieval_mode) == (1, None, "failed") and r.retrieval_error.startswith(mode)
    with pytest.raises(ValueError):
        retrieval.retrieve("other", chunks, vectors, asked, 2)


def test_threshold_and_order(spark):
    c = candidates(spark, [(1, 1, "a", "", 3, "f", None, None), (1, 2, "b", "", 3, "f", 0.5, None), (1, 3, "c", "", 3, "f", 0.5, 0.9)])
    assert [r.chunk_id for r in retrieval.above(c, 0.0).collect()] == ["a", "b", "c"]
    assert [r.chunk_id for r in retrieval.above(c, 0.6).collect()] == ["c"]
    assert [r.chunk_id for r in retrieval.by_score(c).orderBy("rank").collect()] == ["c", "b", "a"]


def test_merge_counts_and_missing_parents(spark):
    c = candidates(spark, [(1, 1, "a", "p", 3, "f", 0.1, None), (1, 2, "b", "q", 3, "f", 0.9, None), (1, 3, "c", "p", 3, "f", 0.7, None), (1, 4, "d", "q", 3, "f", 0.2, None), (1, 5, "e", " ", 3, "f", 0.3, None), (1, 6, "g", None, 3, "f", 0.3, None)])
    parents = spark.createDataFrame([("p", "", 2, "f")], "chunk_id string, parent_chunk_id string, chunk_level int, filename string")
    got = merging.auto_merge(c, parents).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("p", 0.7), ("b", 0.9), ("d", 0.2), ("e", 0.3), ("g", 0.3)]
    meta = merging.auto_merge_meta(c, parents).first()
    assert (meta.pre, meta.post, meta.replaced, meta.steps) == (6, 5, 2, 1)


def test_neighbours(spark):
    c = candidates(spark, [(1, 1, "f::p0::l3::1", "", 3, "f", 1.0, None), (1, 2, "f::p0::l3::3", "", None, "f", 0.9, None), (1, 3, "odd", "", 3, "f", 0.5, None), (1, 4, "f::p0::l2::0", "", 2, "f", 0.5, None)])
    chunks = spark.createDataFrame([(f"f::p0::l3::{i}", "", 3, "f") for i in range(5)], "chunk_id string, parent_chunk_id string, chunk_level int, filename string")
    got = merging.expand_neighbours(c, chunks).orderBy("rank").collect()
    assert [r.chunk_id[-1] for r in got if r.adjacent_added] == ["0", "2", "4"] and all(r.score is None for r in got if r.adjacent_added)
    origins = merging.neighbours(c, chunks).filter("chunk_id LIKE '%::2'").first().asks
    assert [(a.adjacent_to_chunk_id[-1], a.relative_position) for a in origins] == [("1", "next"), ("3", "previous")]
    meta = merging.neighbour_meta(c, chunks).first()
    assert (meta.not_leaf, meta.unparseable, meta.requested, meta.present, meta.added, meta.fallback_reason) == (0, 2, 3, 0, 3, "unparseable_l3_candidates_skipped")


def test_fusion_and_rerank(spark):
    a = candidates(spark, [(1, 1, "x", "", 3, "f", 0.2, None), (1, 2, "y", "", 3, "f", 0.9, None)])
    b = candidates(spark, [(1, 1, "y", "", 3, "f", 0.4, None), (1, 2, "z", "", 3, "f", 0.1, None)])
    got = merging.fuse_rewrites(a, b).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.label) for r in got] == [("x", 0.2, "initial"), ("y", 0.9, "both"), ("z", 0.1, "rewritten")]
    kept = merging.fuse_or_keep(a, b.limit(0)).collect()
    assert len(kept) == 2 and all(r.fallback_reason for r in kept)
    asked = spark.createDataFrame([(1, "one two")], "query_id int, text string")
    texts = spark.createDataFrame([("x", "one two"), ("y", "three")], "chunk_id string, text string")
    first = merging.rerank(a, asked, texts, 1).first()
    assert (first.chunk_id, first.rrf_rank, first.rerank_score) == ("x", 1, 1.0)
    fallback = merging.rerank(a, asked, texts, 2, lambda p: p.limit(0).select("query_id", "rank", F.lit(0.0).alias("rerank_score"))).orderBy("rank").collect()
    assert [r.chunk_id for r in fallback] == ["y", "x"]
    twice = merging.deduplicate(a.union(candidates(spark, [(1, 3, "x", "", 3, "f", 0.8, None)]))).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in twice] == [("x", 0.8), ("y", 0.9)]


def test_lookups(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, level int")
    request = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "a"), (3, "b")], "pos int, chunk_id string")
    assert [r.chunk_id for r in retrieval.in_request_order(parents, request).orderBy("pos").collect()] == ["b", "a", "b"]
    assert retrieval.by_ids(parents, spark.createDataFrame([("a",), (" ",), (None,)], "chunk_id string")).count() == 1
    assert retrieval.allowed_files(spark.createDataFrame([("f",)], "filename string"), [" ", ""]).count() == 1


def test_routes(spark):
    row = spark.createDataFrame([(True, "strong", "sufficient", "none", "answer", False, 0)], "d boolean, r string, a string, m string, w string, s boolean, n int")
    assert row.select(routing.route(*[F.col(c) for c in row.columns]).alias("x")).first().x == "answer"
    told = lambda *a: row.select(routing.tool_output(*[F.lit(x) for x in a[:-1]], F.array(*[F.lit(x) for x in a[-1]])).alias("x")).first().x
    assert told("no_knowledge", None, "c", None, []).startswith("NO_KNOWLEDGE: No reliable")
    assert told("answerable", "clarify", "c", "", []).startswith("NEEDS_CLARIFICATION: I found related") and told(None, "scope_select", "c", "which?", ["a", "b"]) == "NEEDS_SCOPE_SELECTION: which?\nOptions: a; b"
    assert told("answerable", "answer", "", None, []).startswith("No relevant") and told("partial", "answer", "[1] x", None, []) == "Retrieved Chunks:\n[1] x"
    assert row.select(routing.refined_question(F.lit("q"), F.lit(" b ")).alias("x")).first().x == "b：q"


def test_metrics_of_nothing_are_null(spark):
    none = spark.createDataFrame([], "strategy string, best_rank int, latency_ms double, failed boolean, fallback boolean")
    assert evaluate.retrieval_metrics(none, []).first().recall_at_1 is None
    one_failed = spark.createDataFrame([("s", 1, 1.0, False, False), ("s", None, 9.0, True, False)], none.schema)
    got = evaluate.retrieval_metrics(one_failed, ["strategy"]).first()
    assert (got.cases, got.failed, got.recall_at_1, got.mrr_at_10, got.p95_ms) == (2, 1, 0.5, 0.5, 9.0)


def test_grading_and_manifest(spark):
    answers = spark.createDataFrame([("a", "pass", ["f"], []), ("b", "pass", ["f"], []), ("c", None, [], []), ("d", " PASS", ["f", "g"], []), ("e", "pass", ["f"], ["x"]), ("f", "pass", ["f"], [])], "case_id string, verdict string, expected_facts array<string>, forbidden_claims array<string>")
    facts = spark.createDataFrame([("a", 1, "met"), ("b", 1, "Missing "), ("d", 2, "met"), ("d", 3, "missing"), ("f", 1, "supported")], "case_id string, fact_index int, status string")
    claims = spark.createDataFrame([("a", 1, True), ("e", 1, True)], "case_id string, claim_index int, mentioned boolean")
    out = {r.case_id: r for r in evaluate.grade(answers, facts, claims).collect()}
    assert {k: r.verdict for k, r in out.items()} == {"a": "pass", "b": "fail", "c": "review", "d": "pass", "e": "fail", "f": "pass"}
    assert out["d"].statuses == ["review", "met"] and out["f"].statuses == ["review"] and out["e"].forbidden == 1
    ids = answers.select("case_id").filter("case_id < 'd'")
    assert evaluate.freeze_manifest(ids, ids.limit(0), 3).first().case_count == 3
    with pytest.raises(Exception, match="contract"):
        evaluate.freeze_manifest(ids, ids, 3).collect()
    assert evaluate.unpaired(ids, ids.filter("case_id <> 'a'")).first().case_id == "a"


def test_sampling(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "key string, n int")
    assert {r.key: r.quota for r in sampling.largest_remainder(sizes, 4).collect()} == {"a": 1, "b": 1, "c": 2}
    top = spark.createDataFrame([(0, "q0", 1, "x"), (0, "q0", 2, "y"), (0, "q0", 3, "z"), (1, "q1", 1, "x"), (1, "q1", 2, "z")], "case_pos int, case_id string, rank int, doc string")
    assert {(r.case_id, r.doc) for r in sampling.hard_negatives(top).collect()} == {("q0", "x"), ("q0", "y"), ("q1", "z")}
    assert sampling.twister_sample(spark, ["b", "a", "c"], 2, 7).count() == 2


def test_tables(spark, tmp_path):
    with pytest.raises(Exception, match="levels 1 and 2"):
        tables.parents_only(spark.createDataFrame([("a", 3)], "chunk_id string, chunk_level int")).collect()
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    for _ in range(2):
        tables.write_once(spark, df, f"{tmp_path}/once")
    with pytest.raises(ValueError):
        tables.write_once(spark, df.withColumn("v", F.lit(2)), f"{tmp_path}/once")
    old = spark.createDataFrame([("c", "f", 3, False)], "chunk_id string, filename string, chunk_level int, has_vector boolean")
    with pytest.raises(Exception, match="no vector"):
        tables.rechunk(old, old, spark.createDataFrame([("g",)], "filename string")).collect()
    df.withColumn("corpus_run_id", F.lit("r1")).write.partitionBy("corpus_run_id").parquet(f"{tmp_path}/runs")
    assert tables.drop_run(spark, f"{tmp_path}/runs", "r1") and not tables.drop_run(spark, f"{tmp_path}/runs", "r1") and not tables.drop_run(spark, f"{tmp_path}/runs", "../x")
    chunks = spark.createDataFrame([("a", "one two"), ("b", "two")], "chunk_id string, text string")
    tables.create_tables(chunks, f"{tmp_path}/tables")
    asked = spark.createDataFrame([(1, "two"), (2, "none"), (3, None), (4, "ONE one")], "query_id int, text string")
    index = retrieval.open_index(spark, f"{tmp_path}/tables/index")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    assert key(retrieval.search(index, asked, 5)) == key(retrieval.bm25(chunks, asked, 5))
    assert [x[2] for x in key(retrieval.search(index, asked, 5))] == ["b", "a", "a"] and len(key(retrieval.search(index, asked, 1))) == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbfhello\nworld")
    (tmp_path / "b.html").write_bytes("<meta charset=gbk><p>页".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "d.pdf").write_bytes(b"x")
    (tmp_path / "e.txt").write_bytes(b"")
    good, bad = readers.read_folder(spark, str(tmp_path))
    assert {r.filename: r.text for r in good.collect()} == {"a.md": "hello\nworld", "b.html": "<meta charset=gbk><p>页"}
    assert {r.filename: r.reason for r in bad.collect()} == {"c.txt": "not UTF-8", "d.pdf": "needs a converter"}
    assert readers.read_text(spark, str(tmp_path / "a.md")).first().text == "hello\nworld"
    assert readers.read_html(spark, str(tmp_path / "b.html")).first().html.endswith("页")
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "x"}\n\n{"id": "2", "question": " "}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "q.jsonl"), "id string, question string").count() == 2
    with pytest.raises(Exception, match="no question"):
        readers.read_jsonl(spark, str(tmp_path / "q.jsonl"), "id string, question string", ["question"]).collect()
    raw = spark.createDataFrame([([("", "null_query", []), (" q ", "inference_query", ['{"url": "u"}', "plain"])],)], "items array<struct<query: string, question_type: string, evidence_list: array<string>>>")
    r = readers.multihop_cases(readers.items_of(raw)).first()
    assert (r.case_no, r.question, r.question_type, r.evidence) == (2, "q", "inference", ["u", "plain"])
    texts = spark.createDataFrame([("a", "x"), ("b", " ")], "document_id string, text string")
    assert readers.canonical_markdown(texts, texts.filter("document_id = 'a'")).first().text == "x\n"
    with pytest.raises(ValueError, match="missing documents: b"):
        readers.canonical_markdown(texts, texts)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, "2024-01-01 00:00:00"), ("r", 1, "2024-01-01 00:00:02"), ("s", 0, "2024-01-01 00:00:01")], "request_id string, seq long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/steps")
    stream = views.read_events(spark, f"{tmp_path}/steps", rows.schema)
    got = {(r.request_id, r.seq): (r.elapsed_ms, r.stage_elapsed_ms) for r in views.drained(spark, views.step_clock(stream), "append").collect()}
    assert got == {("r", 0): (0, 0), ("r", 1): (2000, 2000), ("s", 0): (0, 0)}
    docs = spark.createDataFrame([("f", "text")], "filename string, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    q = views.ingest(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs"), lambda b: b.withColumn("chunk_level", F.lit(3)), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    assert tables.latest_valid(spark.read.parquet(f"{tmp_path}/out")).count() == 1


def test_jobs(spark):
    e = spark.createDataFrame([(1, 1, "running", 140.0), (1, 2, "failed", 50.0), (1, 3, "running", -5.0), (2, 1, "pending", None)], "job_id int, seq int, state string, percent double")
    got = {r.job_id: (r.state, r.percent) for r in sessions.job_state(e).collect()}
    assert got[1] == ("failed", 0.0) and got[2][0] == "pending"


@pytest.mark.parametrize("limit", [1 << 26, 10])
def test_holders_of_passages(spark, monkeypatch, limit):
    """Every text that holds a passage, however it is cut: in place for few passages, which shuffles nothing, and by a join for more."""
    monkeypatch.setattr(evaluate, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    words = ["a", "bé", "the", "of", "xyz", "Ñ", "q9"]
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randrange(0, 80))) for _ in range(300)] + [None, "", " ", "\u00a0a of"]
    whole = [t for t in texts if t]
    passages = [t[a : a + rng.randrange(0, 60)] for t in whole[:120] for a in [rng.randrange(len(t))]] + ["", None, " a the ", "never in there at all, not once or twice", whole[0], " ".join(words)]
    docs = spark.createDataFrame([(i, "de", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id long, passage string")
    found = evaluate.holders(docs, asked)
    want = sorted((q, i) for q, p in enumerate(passages) if p is not None for i, t in enumerate(texts) if t is not None and p in t)
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == want and len(want) > 500
    assert {r.lang for r in found.collect()} == {"de"} and evaluate.holders(docs, asked.limit(0)).count() == 0
    if limit > 10:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_beginnings_of_passages(monkeypatch):
    """Eight bytes are found at every place, also where two pieces meet, and nowhere else."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(evaluate, "LOOKED_THROUGH", 13)
    rng = random.Random(6)
    data = bytes(rng.choice(b"ab") for _ in range(700))
    keys = np.array(sorted({int(np.frombuffer(data[i : i + 8], np.uint64)[0]) for i in range(0, 60, 7)}), np.uint64)
    may = np.zeros(1 << evaluate.BEGIN_BITS, bool)
    may[evaluate._slot(keys)] = True
    got = sorted((int(p), int(k)) for places, found in evaluate._begins(np.frombuffer(data, np.uint8), keys, may) for p, k in zip(places, found, strict=True))
    every = [(i, int(np.frombuffer(data[i : i + 8], np.uint64)[0])) for i in range(len(data) - 7)]
    assert got == [(i, k) for i, k in every if k in set(keys.tolist())] and len(got) > 10
    texts = pa.array(["x", None, "abcdefgh tail", "", "abcdefgh"]).slice(1)
    whole, bounds = evaluate._bytes(texts)
    assert [whole[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == ["", "abcdefgh tail", "", "abcdefgh"]

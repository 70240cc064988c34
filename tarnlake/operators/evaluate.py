"""Offline evaluation as aggregations (AG-02 to AG-30)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.config import BROADCAST_BYTES
from tarnlake.operators.retrieval import small
from tarnlake.storage import stored


def nearest_rank(x: str, p: float) -> Column:
    """AG-03: the value at place ceil(n p); null for none."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})").cast("double")


#: Rows of a group from which its percentiles are found by narrowing, and buckets of a round.
SORTED_ROWS = 100_000
BUCKETS = 4096


def _size(x: str) -> Column:
    """Sign and power of two of a value, as a number that rises with it."""
    return (F.signum(x) * F.when(F.col(x) == 0, 0).otherwise(F.floor(F.log2(F.abs(x))) + 1100)).cast("long")


def large_percentiles(df: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """AG-03 for groups of any size: ``by, share, value``, the value at place ceil(n p) of each group; groups without values are left out.

    Each round counts the values of the interval that the place lies in by parts of it, before the shuffle, and goes on
    with the part where it lies, from its least to its greatest value: parts are first the values of one sign and power of two, then
    equal ones, so half a dozen rounds are the most. What is left of a group is sorted when it has ``SORTED_ROWS``
    rows at most, and not at all when it is one value. Only groups above that are looked at again.
    """
    spark = df.sparkSession
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.struct(F.col(f"`{b}`").alias("v")).alias(k) for b, k in zip(by, keys, strict=True)], F.col(f"`{column}`").cast("double").alias("__x")).filter("__x IS NOT NULL")
    total = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).filter("__n > 0")
    place = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), F.greatest(F.ceil(F.col("__n") * F.lit(float(p))), F.lit(1)).cast("long").alias("rank")) for p in shares]))
    at = total.withColumn("__p", place).select(*keys, "__n", "__lo", "__hi", F.col("__p.share").alias("__share"), F.col("__p.rank").alias("__rank"))
    at = stored(spark, at, "percentile-intervals")
    met = lambda state: rows.join(state, keys) if keys else rows.crossJoin(F.broadcast(state))  # noqa: E731  without groups a row for each share
    while not (wide := at.filter(f"__n > {SORTED_ROWS} AND __lo < __hi")).isEmpty():
        inside = met(wide).filter("__x BETWEEN __lo AND __hi")
        within = F.try_divide(F.col("__x") / 2 - F.col("__lo") / 2, F.col("__hi") / 2 - F.col("__lo") / 2)  # halves, as the width may have no double
        even = F.coalesce(F.least(F.floor(within * BUCKETS), F.lit(BUCKETS - 1)), (F.col("__x") > F.col("__lo")).cast("long"))
        part = F.when(_size("__lo") < _size("__hi"), _size("__x")).otherwise(even).alias("__part")
        counted = inside.groupBy(*keys, "__share", "__rank", part).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        upto = F.sum("__n").over(Window.partitionBy(*keys, "__share").orderBy("__part"))
        chosen = counted.withColumn("__upto", upto).filter("__rank <= __upto AND __rank > __upto - __n").withColumn("__rank", F.col("__rank") - (F.col("__upto") - F.col("__n")))
        at = stored(spark, at.filter(f"NOT (__n > {SORTED_ROWS} AND __lo < __hi)").unionByName(chosen.select(*at.columns)), "percentile-intervals")
    same = at.filter("__lo = __hi").withColumn("value", F.col("__lo"))
    few = met(at.filter("__lo < __hi")).filter("__x BETWEEN __lo AND __hi").groupBy(*keys, "__share").agg(F.element_at(F.sort_array(F.collect_list("__x")), F.first("__rank").cast("int")).alias("value"))
    found = same.select(*keys, "__share", "value").unionByName(few)
    return found.select(*[F.col(f"{k}.v").alias(b) for b, k in zip(by, keys, strict=True)], F.col("__share").alias("share"), "value")


def share(condition: Column) -> Column:
    """Share of rows for which it holds; an unknown one counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def retrieval_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """AG-02, AG-08: ``best_rank`` (null: not found), ``latency_ms`` (null: not measured), ``failed``, ``fallback`` per case.

    Recall and reciprocal rank are divided by all cases, failed ones included; latencies are those that were measured.
    """
    best = F.col("best_rank")
    of_all = lambda c, value: F.avg(F.when(c, value).otherwise(0.0))
    return results.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if("failed").alias("failed"),
        F.count_if("fallback").alias("fallbacks"),
        *[F.round(of_all(best <= k, F.lit(1.0)), 6).alias(f"recall_at_{k}") for k in (1, 3, 5)],
        F.round(of_all(best <= 10, 1.0 / best), 6).alias("mrr_at_10"),
        *[nearest_rank("latency_ms", p).alias(n) for p, n in ((0.5, "p50_ms"), (0.95, "p95_ms"))],
    )


def coverage(expected: DataFrame, found: DataFrame, refusal: str = "refusal") -> DataFrame:
    """AG-06, AG-07: share of a case's gold documents that were found; without gold 1 for refusal cases, else 0."""
    hits = expected.join(found.select("case_id", "document").distinct().withColumn("hit", F.lit(1)), ["case_id", "document"], "left")
    one = hits.groupBy("case_id", refusal).agg(F.count("document").alias("gold"), F.count(F.when(F.col("document").isNotNull(), F.col("hit"))).alias("hits"))
    return one.withColumn("coverage", F.round(F.when(F.col("gold") == 0, F.when(F.col(refusal), 1.0).otherwise(0.0)).otherwise(F.col("hits") / F.col("gold")), 6))


def multihop_metrics(results: DataFrame) -> DataFrame:
    """AG-05, with its four denominators: answerable cases, all cases, judged cases, refusal cases.

    Columns: refusal, refusal_correct (whether the answer refused, judged on its own), coverage, verdict (pass, fail, review or
    null), rewrite, split, merged, total_s, rag_s, answer_s. Medians are values at the nearest rank; a missing time counts as 0.
    """
    judged = F.col("verdict").isin("pass", "fail", "review")
    effective = F.coalesce("coverage", F.lit(0.0))
    return results.agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.when(~F.col("refusal"), F.when(effective >= 1, 1.0).otherwise(0.0))), 6).alias("full_coverage"),
        F.round(F.avg(effective), 6).alias("average_coverage"),
        F.round(F.avg(F.when(judged, F.when(F.col("verdict") == "pass", 1.0).otherwise(0.0))), 6).alias("pass_rate"),
        F.round(F.avg(F.when(F.col("refusal"), F.when(F.col("refusal_correct"), 1.0).otherwise(0.0))), 6).alias("refusal_correct"),
        F.round(share(F.col("verdict") == "review"), 6).alias("review_rate"),
        *[nearest_rank(f"coalesce({c}, 0.0)", 0.5).alias(f"median_{c}") for c in ("total_s", "rag_s", "answer_s")],
        *[F.round(share(F.col(c)), 6).alias(f"{c}_rate") for c in ("rewrite", "split", "merged")],
    )


def paired_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """AG-13: rates over all rows, whatever was judged."""
    return results.groupBy(*by).agg(F.count("*").alias("cases"), F.round(share(F.col("coverage") >= 1), 6).alias("full"), F.round(F.avg("coverage"), 6).alias("average"), F.round(share(F.col("coverage") == 0), 6).alias("zero"), F.round(share(F.col("verdict") == "pass"), 6).alias("pass"))


def eligible(results: DataFrame) -> DataFrame:
    """AG-09: strategies all of whose calls succeeded."""
    return results.groupBy("strategy").agg(F.bool_and(~F.col("failed")).alias("ok")).filter("ok").select("strategy")


def _told(name: str) -> Column:
    """Whether an error field says something."""
    return F.coalesce(F.trim(F.col(name)) != "", F.lit(False))


def system_error() -> Column:
    """FL-07: the run, the answer's generation, the judge or the evidence grader failed."""
    return _told("evaluation_error") | _told("answer_error") | _told("grader_error") | F.coalesce(F.col("evidence_reason") == "evidence_grading_unavailable", F.lit(False))


def retryable() -> Column:
    """FL-06: no stable outcome of answer and grade; worth another attempt."""
    return _told("evaluation_error") | _told("answer_error") | _told("grader_error")


def quota_spent() -> Column:
    """FL-06: the provider will refuse every further call."""
    e = F.coalesce("evaluation_error", F.lit(""))
    return F.contains(e, F.lit("APIStatusError: Error code: 402")) | F.contains(e, F.lit("account balance is insufficient"))


#: AG-11, fixed values, in the order of reports. Nothing is ever classed as a hard distractor.
FAILURES = ("retrieval_miss", "retrieval_late", "hard_distractor", "evidence_incomplete", "answer_failure", "refusal_failure", "human_review", "system_error")


def failure_labels() -> Column:
    """AG-11: all categories that apply to a result; they overlap.

    Columns: verdict, the error fields of FL-07, question_type, refusal_correct, expected (gold documents), ranks (of those found), coverage.
    """
    system, verdict = system_error(), F.lower(F.coalesce("verdict", F.lit("review")))
    gold, found = F.coalesce(F.size("expected") > 0, F.lit(False)), F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: r.isNotNull())
    say = lambda c, label: F.when(F.coalesce(c, F.lit(False)), F.lit(label))
    return F.array_compact(F.array(
        say(gold & (F.size(found) == 0), "retrieval_miss"),
        say((F.size(found) > 0) & (F.array_min(found) > 3), "retrieval_late"),
        say(gold & (F.col("coverage") > 0) & (F.col("coverage") < 1), "evidence_incomplete"),
        say((verdict == "fail") & ~system, "answer_failure"),
        say((F.col("question_type") == "info_not_found") & ~(F.coalesce("refusal_correct", F.lit(False)) & (verdict == "pass")), "refusal_failure"),
        say((verdict == "review") & ~system, "human_review"),
        say(system, "system_error"),
    ))


def failure_counts(results: DataFrame) -> DataFrame:
    """AG-11: cases per category, also where there are none."""
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("label")) for i, n in enumerate(FAILURES)])).alias("c")
    every = results.sparkSession.range(1).select(names).select("c.*")
    n = results.select(F.explode(failure_labels()).alias("label")).groupBy("label").agg(F.count("*").alias("cases"))
    return every.join(n, "label", "left").na.fill(0, ["cases"]).select("position", "label", "cases")


def verdict_counts(results: DataFrame) -> DataFrame:
    """AG-12: cases per verdict, in the order of verdicts; without one a case counts for review."""
    n = results.groupBy(F.coalesce(F.nullif("verdict", F.lit("")), F.lit("review")).alias("verdict")).agg(F.count("*").alias("cases"))
    return n.orderBy("verdict")


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """JN-04: both runs side by side; cases of one run only are an error, told by :func:`unpaired`."""
    b = before.select("case_id", *[F.col(c).alias(f"before_{c}") for c in ("verdict", "coverage", "system_error")])
    a = after.select("case_id", *[F.col(c).alias(f"after_{c}") for c in ("verdict", "coverage", "system_error")])
    return b.join(a, "case_id")


def unpaired(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after, "case_id", "left_anti").select("case_id").unionByName(after.join(before, "case_id", "left_anti").select("case_id"))


def coverage_turn() -> Column:
    return F.when(F.col("after_coverage") > F.col("before_coverage"), "coverage_up").when(F.col("after_coverage") < F.col("before_coverage"), "coverage_down").otherwise("coverage_same")


def transition() -> Column:
    return F.concat("before_verdict", F.lit("_to_"), "after_verdict", F.lit(";"), coverage_turn())


def transitions(pairs: DataFrame) -> DataFrame:
    """AG-14: cases per transition."""
    return pairs.groupBy(transition().alias("transition")).agg(F.count("*").alias("cases"))


def transition_cases(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """AG-14: every case with its transition, a row each; SL-07: the first ``most`` of each by case id."""
    named = pairs.select(transition().alias("transition"), "case_id")
    if most is None:
        return named
    place = F.row_number().over(Window.partitionBy("transition").orderBy("case_id"))
    return named.withColumn("place", place).filter(F.col("place") <= most)


def deltas(pairs: DataFrame) -> DataFrame:
    """AG-16: after minus before, over all cases and over those clean on both sides."""
    clean = ~F.col("before_system_error") & ~F.col("after_system_error")
    rows = pairs.select("*", F.explode(F.when(clean, F.array(F.lit("all"), F.lit("clean"))).otherwise(F.array(F.lit("all")))).alias("scope"))
    p = lambda side: F.avg(F.when(F.col(f"{side}_verdict") == "pass", 1.0).otherwise(0.0))
    f = lambda side: F.avg(F.when(F.col(f"{side}_coverage") >= 1, 1.0).otherwise(0.0))
    return rows.groupBy("scope").agg(F.count("*").alias("cases"), F.round(F.avg("after_coverage") - F.avg("before_coverage"), 6).alias("average_delta"), F.round(p("after") - p("before"), 6).alias("pass_delta"), F.round(f("after") - f("before"), 6).alias("full_delta"))


def attribution_label(controlled: bool = True) -> Column:
    """AG-15: what a change is put down to. ``controlled``: errors on either side rule a comparison out."""
    up, down = coverage_turn() == "coverage_up", coverage_turn() == "coverage_down"
    passed = F.col("after_verdict") == "pass"
    won = (F.col("before_verdict") != "pass") & passed
    if not controlled:
        return (
            F.when(won & up, "evidence_recovered_and_answer_pass_candidate")
            .when(won, "answer_pass_without_evidence_coverage_gain")
            .when(up, "evidence_recovered_but_answer_not_pass")
            .when(down, "evidence_coverage_regressed")
            .otherwise("no_measurable_evidence_coverage_change")
        )
    return (
        F.when(F.col("after_system_error"), "system_error")
        .when(F.col("before_system_error"), "baseline_system_error_no_comparison")
        .when(won & up, "evidence_recovered_and_answer_pass_candidate")
        .when(up, "evidence_recovered_but_answer_not_pass")
        .when(down, "evidence_coverage_regressed")
        .when(won, "answer_pass_without_coverage_gain")
        .otherwise("no_measurable_evidence_coverage_change")
    )


def attribution(pairs: DataFrame, controlled: bool = True) -> DataFrame:
    """AG-15: cases per attribution."""
    return pairs.groupBy(attribution_label(controlled).alias("cause")).agg(F.count("*").alias("cases"))


def grade(answers: DataFrame, facts: DataFrame, claims: DataFrame) -> DataFrame:
    """AG-27: the judge's word beside its own details; a pass becomes a fail if a fact is missing or contradicted or a forbidden claim is made.

    ``answers`` (case_id, verdict, expected_facts array, forbidden_claims array), ``facts`` (case_id, fact_index, status) and ``claims`` (case_id,
    claim_index, mentioned) are what the judge returned: in any order, by numbers from 1, incomplete, or about what wasn't asked. A
    fact that it left out, or gave another status than met, missing, contradicted or review, is for review and fails nothing; a
    claim left out was not made. Of two results of one number the last by ``seen`` counts where there is such a column, else any.
    ``statuses`` follows the expected facts. Without a known verdict the case is for review.
    """
    last = lambda df, value: F.max_by(value, "seen") if "seen" in df.columns else F.any_value(value)
    clean = lambda c: F.trim(F.lower(c))
    told = facts.groupBy("case_id", "fact_index").agg(last(facts, "status").alias("status")).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("fact_index", "status"))).alias("told"))
    made = claims.groupBy("case_id", "claim_index").agg(last(claims, "mentioned").alias("mentioned")).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("claim_index", "mentioned"))).alias("made"))
    out = answers.join(told, "case_id", "left").join(made, "case_id", "left")
    numbers = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c)))
    state = lambda i: F.when(clean(F.try_element_at("told", i)).isin("met", "missing", "contradicted", "review"), clean(F.try_element_at("told", i))).otherwise("review")
    statuses = F.coalesce(F.transform(numbers("expected_facts"), state), F.array().cast("array<string>"))
    forbidden = F.coalesce(F.size(F.filter(numbers("forbidden_claims"), lambda i: F.coalesce(F.try_element_at("made", i), F.lit(False)))), F.lit(0))
    given = F.when(clean(F.col("verdict")).isin("pass", "fail", "review"), clean(F.col("verdict"))).otherwise("review")
    out = out.withColumn("statuses", statuses).withColumn("forbidden", F.greatest(forbidden, F.lit(0)).cast("long"))
    against = F.exists("statuses", lambda s: s.isin("missing", "contradicted")) | (F.col("forbidden") > 0)
    count = lambda s: F.size(F.filter("statuses", lambda x: x == s)).cast("long").alias(s)
    return out.select("case_id", F.size("statuses").cast("long").alias("facts"), count("met"), count("missing"), count("contradicted"), "forbidden", F.when((given == "pass") & against, "fail").otherwise(given).alias("verdict"), "statuses")


def exam_summary(cases: DataFrame) -> DataFrame:
    """AG-10: one row on a run: http_status, all_recalled, ranks array<int> of the expected documents (null: absent), verdict,
    fact_results array<string>, claims_mentioned array<boolean>, elapsed_s. Rates are rounded half to even; answers and their
    facts count for judged cases only, a rate over nothing is 0, the pass rate null.
    """
    ok = F.col("http_status") == 200
    judged = ok & F.col("verdict").isin("pass", "fail", "review")
    hit = lambda k: (F.size("ranks") > 0) & F.forall("ranks", lambda r: F.coalesce(r <= k, F.lit(False)))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(F.when(judged, c)), F.lit(0)).cast("long")
    sums = cases.agg(
        F.count("*").alias("cases"), n(ok).alias("successful_cases"), n(ok & F.col("all_recalled")).alias("all_expected_docs_recalled"),
        n(ok & F.exists("ranks", lambda r: r == 1)).alias("first_expected_doc_at_1"), n(ok & hit(2)).alias("all_expected_docs_at_2"), n(ok & hit(3)).alias("all_expected_docs_at_3"),
        n(judged).alias("answer_judged_cases"), n(judged & (F.col("verdict") == "pass")).alias("answer_passed_cases"), n(judged & (F.col("verdict") == "review")).alias("answer_review_cases"),
        total(F.size("fact_results")).alias("expected_facts_total"), total(F.size(F.filter("fact_results", lambda r: r == "met"))).alias("expected_facts_met"),
        total(F.size("claims_mentioned")).alias("forbidden_claims_total"), total(F.size(F.filter("claims_mentioned", lambda c: c))).alias("forbidden_claim_violations"),
        F.coalesce(F.bround(F.avg("elapsed_s"), 3), F.lit(0.0)).alias("average_elapsed_seconds"),
    )
    rate = lambda a, b: F.bround(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)
    return sums.withColumn("failed_cases", F.col("cases") - F.col("successful_cases")).withColumn("all_expected_docs_recall_rate", F.coalesce(rate("all_expected_docs_recalled", "successful_cases"), F.lit(0.0))).withColumn("answer_pass_rate", rate("answer_passed_cases", "answer_judged_cases"))


def funnel(stage_table: DataFrame, gold: DataFrame) -> DataFrame:
    """AG-17: at each stage, in how many cases an expected document is present."""
    cases = gold.select("query_id").distinct()
    hits = stage_table.join(gold, ["query_id", "filename"], "left_semi").groupBy("stage").agg(F.count_distinct("query_id").alias("hits"))
    seen = stage_table.join(cases, "query_id", "left_semi").groupBy("stage").agg(F.count_distinct("query_id").alias("cases"))
    return seen.join(hits, "stage", "left").na.fill(0, ["hits"])


def latency_table(results: DataFrame, columns: list[str]) -> DataFrame:
    """AG-18: p50 and p95 of each timing column, however many rows there are."""
    long = results.unpivot([], columns, "part", "ms")
    found = large_percentiles(long, ["part"], "ms", [0.5, 0.95]).groupBy("part").agg(F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("share") == 0.95, F.col("value"))).alias("p95"))
    return long.groupBy("part").agg(F.count("ms").alias("n")).join(found, "part", "left").select("part", "p50", "p95", "n")


#: Words of a shingle that finds the texts a passage may be in. Its first and last word may be parts of a text's words.
GOLD_SHINGLE = 5


def holders(docs: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``query_id`` and the columns of ``docs`` (``key``, text and others) but its text, where it holds ``passages.passage`` as it is.

    Passages of up to ``BROADCAST_BYTES`` go to the texts, which stay where they lie: every eight bytes of the texts are looked up among the first
    eight of each passage, and it is compared where they agree. More passages meet the shingles of all texts in a shuffle.
    """
    told = passages.filter("passage IS NOT NULL").select("query_id", "passage")
    width = told.agg(F.coalesce(F.sum(F.octet_length("passage") + 64), F.lit(0))).first()[0]
    return _holders_in_place(docs, told) if width <= BROADCAST_BYTES else _holders_by_join(docs, told, key)


#: Bytes of the texts that are looked through at a time, and bits of the table of what passages begin with.
LOOKED_THROUGH = 1 << 20
BEGIN_BITS = 20


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes one after the other, and where each begins and the last ends."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _slot(eights: np.ndarray) -> np.ndarray:
    return (eights * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BEGIN_BITS)


def _eights(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as a number."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(np.uint64)[:, 0]


def _begins(data: np.ndarray, keys: np.ndarray, may: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places where eight bytes are one of ``keys``, and which, some bytes at a time; ``may`` has the slots of the keys."""
    for a in range(0, len(data) - 7, LOOKED_THROUGH):
        piece = data[a : a + LOOKED_THROUGH + 7]
        places, found = [], []
        for i in range(8):
            eights = piece[i : i + (len(piece) - i) // 8 * 8].view(np.uint64)
            at = np.flatnonzero(may[_slot(eights)])
            at = at[np.isin(eights[at], keys)]
            places.append(a + i + at * 8)
            found.append(eights[at])
        yield np.concatenate(places), np.concatenate(found)


def _holders_in_place(docs: DataFrame, passages: DataFrame) -> DataFrame:
    held = passages.toArrow()
    names, texts = held.column("query_id"), [p.encode() for p in held.column("passage").to_pylist()]
    asked: dict[int, list[int]] = {}
    for q, p in enumerate(texts):
        if len(p) >= 8:
            asked.setdefault(int(np.frombuffer(p[:8], np.uint64)[0]), []).append(q)
    short = [q for q, p in enumerate(texts) if len(p) < 8]
    kept = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast((names.combine_chunks(), texts, np.array(sorted(asked), np.uint64), asked, short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, passages, keys, asked, short = sent.value
        may = np.zeros(1 << BEGIN_BITS, bool)
        may[_slot(keys)] = True
        for b in batches:
            body = b.column("text")
            found: set[tuple[int, int]] = set()
            if len(keys) and b.num_rows:
                data, bounds = _bytes(body)
                for places, begins in _begins(data, keys, may):
                    row = np.searchsorted(bounds, places, side="right") - 1
                    for key in np.unique(begins).tolist():
                        mine = (begins == key) & (row >= 0) & (row < b.num_rows)
                        for q in asked[key]:
                            p = passages[q]
                            fits = places[mine] + len(p) <= bounds[row[mine] + 1]
                            at, k = places[mine][fits], row[mine][fits]
                            for i in (len(p) - 8, len(p) // 2 - 4):  # its last bytes and those in its middle, at all places at once
                                same = _eights(data, at + i) == np.frombuffer(p[i : i + 8], np.uint64)[0]
                                at, k = at[same], k[same]
                            for x, r in zip(at.tolist(), k.tolist(), strict=True):
                                if (r, q) not in found and data[x : x + len(p)].tobytes() == p:
                                    found.add((r, q))
            for q in short:
                found |= {(k, q) for k in pc.indices_nonzero(pc.fill_null(pc.match_substring(body, passages[q].decode()), False)).to_pylist()}
            pairs = sorted(found)
            rows = pa.array([k for k, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([names.take(pa.array([q for _, q in pairs], pa.int64())), *[b.column(c).take(rows) for c in kept]], ["query_id", *kept])

    kinds = dict(docs.dtypes)
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([f"query_id {dict(passages.dtypes)['query_id']}", *[f"`{c}` {kinds[c]}" for c in kept]]))


def _holders_by_join(docs: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    n = GOLD_SHINGLE
    kept = [c for c in docs.columns if c != "text"]
    asked = passages.withColumn("ws", F.split("passage", r"\s+"))
    long = asked.filter(F.size("ws") >= n + 2).select("query_id", "passage", F.xxhash64(F.slice("ws", 2, n)).alias("shingle"))
    short = small(asked.filter(F.size("ws") < n + 2).drop("ws"), width=64)
    cut = docs.select(key, F.split("text", r"\s+").alias("ws")).filter(F.size("ws") >= n)
    held = cut.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - (n - 1)), lambda i: F.xxhash64(F.slice("ws", i, n))))).alias("shingle"))
    may = held.join(long.select("query_id", "shingle"), "shingle").select(key, "query_id").distinct()
    found = docs.join(may, key).join(long.select("query_id", "passage"), "query_id").filter(F.contains("text", "passage"))
    return found.select("query_id", *kept).unionByName(docs.join(short, F.contains("text", "passage")).select("query_id", *kept))


def _kept_gold(pool: DataFrame, k: int) -> DataFrame:
    return pool.filter("gold").groupBy("query_id").agg(F.count("*").alias("gold"), F.count_if(F.col("old_rank") <= k).alias("old"), F.count_if(F.col("new_rank") <= k).alias("new"))


def rerank_shadow(pool: DataFrame, k: int) -> DataFrame:
    """JN-06, AG-19: on one fixed pool (query_id, filename, old_rank, new_rank, gold), how much gold each reranker keeps in its first ``k``."""
    return _kept_gold(pool, k).agg(F.count("*").alias("cases"), F.round(share(F.col("old") == F.col("gold")), 6).alias("old_full"), F.round(share(F.col("new") == F.col("gold")), 6).alias("new_full"), F.round(F.avg(F.col("old") / F.col("gold")), 6).alias("old_average"), F.round(F.avg(F.col("new") / F.col("gold")), 6).alias("new_average"), F.count_if(F.col("new") > F.col("old")).alias("improved"), F.count_if(F.col("new") < F.col("old")).alias("worsened"))


def rerank_shadow_cases(pool: DataFrame, k: int) -> DataFrame:
    """AG-19: the queries that keep more or less gold, a row each."""
    turn = F.when(F.col("new") > F.col("old"), "improved").when(F.col("new") < F.col("old"), "worsened")
    return _kept_gold(pool, k).withColumn("turn", turn).filter("turn IS NOT NULL").select("query_id", "turn", "gold", "old", "new")


def review_reasons() -> Column:
    """AG-26: all reasons why a person should look at a result."""
    say = lambda c, label: F.when(F.coalesce(c, F.lit(False)), F.lit(label))
    verdict, covered = F.col("verdict"), F.coalesce("coverage", F.lit(0.0))
    return F.array_compact(F.array(
        say(verdict == "review", "grader_review"),
        say((F.col("case_set") == "validation") & ~F.coalesce(verdict == "pass", F.lit(False)), "validation_failure"),
        say((verdict == "fail") & (covered >= 1), "evidence_complete_answer_failed"),
        say((verdict == "pass") & (covered < 1), "answer_passed_evidence_incomplete"),
        say(system_error(), "system_error"),
    ))


def review_queue(results: DataFrame, blind: bool = True) -> DataFrame:
    """AG-26: cases for a person with all reasons; ``blind`` runs show of the validation set only that a case waits."""
    hidden = F.coalesce(F.col("case_set") == "validation", F.lit(False)) & F.lit(blind)
    queue = results.withColumn("reasons", review_reasons()).filter(F.size("reasons") > 0)
    return queue.select("case_set", F.when(~hidden, F.col("case_id")).alias("case_id"), F.when(~hidden, F.col("question")).alias("question"), F.when(hidden, F.array(F.lit("validation_case_suppressed"))).otherwise(F.col("reasons")).alias("reasons"), hidden.alias("redacted"))


def language_observations(cases: DataFrame) -> DataFrame:
    """AG-25: what complex questions with Latin letters sent to retrieval, and what breaks the language policy.

    ``cases``: case_id, question, the error fields of FL-06, complexity, sub_questions and candidate_queries (array<string>).
    One row per query seen (``reason`` Chinese characters or null) and per trace that is missing.
    """
    checked = cases.filter(F.col("question").rlike("[A-Za-z]") & ~retryable() & F.coalesce(F.col("complexity") == "complex", F.lit(False)))
    seen = lambda name, pattern: F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda q, i: F.struct(F.format_string(pattern, i + 1).alias("location"), F.trim(q).alias("query"))), lambda o: o["query"] != "")
    subs, asked = seen("sub_questions", "rag_trace.sub_questions[%d]"), seen("candidate_queries", "candidate_audits[%d].query")
    chinese = lambda o: F.struct(o["location"].alias("location"), o["query"].alias("query"), F.when(o["query"].rlike("[㐀-鿿]"), F.lit("chinese_characters")).alias("reason"))
    missing = lambda found, where, reason: F.when(F.size(found) == 0, F.array(F.struct(F.lit(where).alias("location"), F.lit("").alias("query"), F.lit(reason).alias("reason"))))
    none = F.array().cast("array<struct<location: string, query: string, reason: string>>")
    every = F.concat(F.transform(subs, chinese), F.transform(asked, chinese), F.coalesce(missing(subs, "rag_trace.sub_questions", "missing_actual_sub_questions"), none), F.coalesce(missing(asked, "candidate_audits", "missing_actual_retrieval_query"), none))
    return checked.select("case_id", F.explode(every).alias("o")).select("case_id", "o.*")


def language_compliance(cases: DataFrame) -> DataFrame:
    """AG-25: one row; ``compliant`` is null if no case was checked."""
    latin = F.coalesce(F.col("question").rlike("[A-Za-z]"), F.lit(False))
    complex_ = F.coalesce(F.col("complexity") == "complex", F.lit(False))
    n = cases.agg(F.count_if(latin).alias("english_cases"), F.count_if(latin & retryable()).alias("system_errors"), F.count_if(latin & ~retryable() & complex_).alias("checked_cases"))
    bad = language_observations(cases).agg(F.count("reason").alias("violations"))
    return n.crossJoin(F.broadcast(bad)).withColumn("compliant", F.when(F.col("checked_cases") > 0, F.col("violations") == 0))


def fold_checkpoint(lines: DataFrame) -> DataFrame:
    """AG-28: a case's last record, at the place of its first."""
    return lines.groupBy("case_id").agg(F.min("line_no").alias("position"), F.max_by(F.struct(*[c for c in lines.columns if c not in ("case_id", "line_no")]), "line_no").alias("r")).select("case_id", "position", "r.*")


def resumed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SM-06: of a checkpoint's folded records those that stand, and the failed ones that go to the history and are tried again."""
    return records.filter(~retryable()), records.filter(retryable())


def retry_selection(cases: DataFrame, done: DataFrame) -> DataFrame:
    """AG-29: ``retry`` for cases without a result or with a failed one, others preserved."""
    return cases.join(done.select("case_id", F.col("failed").alias("__failed")), "case_id", "left").select("case_id", F.coalesce("__failed", F.lit(True)).alias("retry"))


def retry_merge(source: DataFrame, attempts: DataFrame) -> DataFrame:
    """AG-30: an attempt replaces the source's record."""
    both = source.withColumn("__p", F.lit(0)).unionByName(attempts.withColumn("__p", F.lit(1)))
    by = Window.partitionBy("case_id").orderBy(F.col("__p").desc())
    return both.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n", "__p")


#: AG-31, fixed values: how many cases each experiment freezes, and the one thing that it may change.
CONTRACTS = {
    "rewrite_candidate_fusion": (15, "rewrite_candidate_fusion"),
    "evidence_candidate_audit": (97, "rewrite_candidate_fusion"),
    "adjacent_l3_expansion": (11, "adjacent_l3_expansion"),
    "structured_chunking_offline_audit": (30, "document_chunking_strategy"),
    "model_comparison": (30, "model"),
    "rerank_model_comparison": (30, "rerank_model"),
    "subquestion_language_policy": (30, "subquestion_language_policy"),
}
#: Of the evidence audit, so many cases of each category make up its 97.
AUDITED = {"retrieval_miss": 63, "retrieval_late": 19, "evidence_incomplete": 19}


def rewritten_cases(records: DataFrame) -> DataFrame:
    """AG-31: analysis cases that a rewrite was really tried on and that ran (case_set, rewrite_method, evaluation_error)."""
    return records.filter((F.col("case_set") == "analysis") & F.col("rewrite_method").isin("step_back", "hyde") & ~_told("evaluation_error"))


def adjacent_gap_cases(reviews: DataFrame) -> DataFrame:
    """AG-31: cases whose missing evidence a person found next to a retrieved leaf."""
    return reviews.filter(F.col("classification") == "adjacent_leaf_gap")


def non_pass_cases(records: DataFrame) -> DataFrame:
    """AG-31: analysis cases without a pass, for the wider run."""
    return records.filter((F.col("case_set") == "analysis") & ~F.coalesce(F.col("verdict") == "pass", F.lit(False)))


def audited_cases(labelled: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """AG-31: ``case_id, label`` rows of the audited categories as ``case_id, categories``; another number in a category is an error."""
    expected = AUDITED if expected is None else expected
    held = labelled.filter(F.col("label").isin(*expected)).distinct()
    counts = held.groupBy().agg(*[F.count_if(F.col("label") == n).alias(n) for n in expected])
    right = F.lit(True)
    for name, n in expected.items():
        right = right & (F.col(name) == n)
    ok = counts.select(F.assert_true(right, F.lit("a category has another number of cases than its contract says")).alias("__ok"))
    cases = held.groupBy("case_id").agg(F.array_sort(F.collect_set("label")).alias("categories"))
    return cases.crossJoin(F.broadcast(ok)).filter("__ok IS NULL").drop("__ok")


def freeze_manifest(cases: DataFrame, validation: DataFrame, contract: str | int) -> DataFrame:
    """AG-31: the frozen cases, a row each in the order of their ids, with a hash over all; fails on another number than the
    contract's, on duplicates, on rows that are not for analysis (where ``case_set`` is known) and on validation cases.

    A contract's number bounds the table, so its ids fit one row.
    """
    expected, variable = CONTRACTS[contract] if isinstance(contract, str) else (contract, None)
    bad = cases.join(validation.select("case_id"), "case_id", "left_semi").agg(F.count("*").alias("leaked"))
    other = F.count_if(F.coalesce(F.col("case_set") != "analysis", F.lit(True))) if "case_set" in cases.columns else F.lit(0)
    # counted first: nothing is gathered if the number is wrong
    one = cases.agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("distinct_n"), other.alias("other"))
    ok = F.coalesce((F.col("n") == expected) & (F.col("distinct_n") == F.col("n")) & (F.col("leaked") == 0) & (F.col("other") == 0), F.lit(False))
    found = one.crossJoin(bad).select(ok.alias("ok")).first()
    if not found.ok:
        raise ValueError("manifest does not meet its contract")
    ids = cases.agg(F.sort_array(F.collect_list("case_id")).alias("ids"))
    return ids.select(F.lit(expected).cast("long").alias("case_count"), F.lit(variable).cast("string").alias("changed_variable"), "ids", F.sha2(F.to_json("ids"), 256).alias("manifest_hash"))

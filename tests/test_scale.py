"""Operators that meet one hot group: against plain versions, with limits set low or groups made large."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import models
from tarnlake.operators import evaluate, inverted, retrieval, sampling, tables
from tarnlake.plans.catalog import QUERIES

SPAN = "filename string, chunk_id string, start long, end long"


def spans(spark, n, seed, width):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(0, 4000)
        rows.append((rng.choice(["f", "f", "f", "g"]), f"{seed}-{i}", a, a + rng.choice([0, 1, 2, 3, width, 7 * width])))
    return spark.createDataFrame([*rows, (None, "n", 1, 5), ("f", "lost", -1, -1), ("f", "none", None, None)], SPAN)


def test_overlaps_by_bins(spark):
    a, b = spans(spark, 300, 1, 60), spans(spark, 300, 2, 33)
    key = lambda df: sorted(tuple(r) for r in df.select("filename", "old_id", "new_id", "old_start", "new_end").collect())
    want = key(tables.overlapping_spans_plain(a, b))
    assert key(tables.overlapping_spans(a, b)) == want and len(want) > 1000
    assert tables.overlapping_spans(a.limit(0), b).count() == 0 and tables.overlapping_spans(a, b.limit(0)).count() == 0


def test_containment_by_bins(spark):
    a, b = spans(spark, 300, 3, 20), spans(spark, 200, 4, 50)
    held = [(r.filename, r.start, r.end) for r in b.collect() if None not in (r.filename, r.start)]
    want = sorted(r.chunk_id for r in a.collect() if not any(f == r.filename and r.start is not None and s <= r.start and r.end <= e for f, s, e in held))
    assert sorted(r.chunk_id for r in tables.uncontained(a, b).collect()) == want and 5 < len(want) < 300
    assert tables.uncontained(a, b.limit(0)).count() == a.count()


def test_one_file_of_many_spans(spark):
    """100,000 spans against as many in one file: pairs are those of neighbours, not of the file."""
    n = 100_000
    old = spark.range(n).select(F.lit("f").alias("filename"), F.col("id").cast("string").alias("chunk_id"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    new = spark.range(n).select(F.lit("f").alias("filename"), F.col("id").cast("string").alias("chunk_id"), (F.col("id") * 10 + 5).alias("start"), (F.col("id") * 10 + 15).alias("end"))
    got = tables.overlapping_spans(old, new)
    assert got.count() == 2 * n - 1 and got.filter("new_id <> old_id AND new_id <> old_id - 1").count() == 0
    assert tables.uncontained(old, new).count() == n and tables.uncontained(old, old).count() == 0


@pytest.mark.parametrize("limit", [100_000, 7])
def test_percentiles_of_large_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluate, "SORTED_ROWS", limit)
    rng = random.Random(5)
    tiny = struct.unpack("d", struct.pack("q", 1))[0]
    rows = [("a", rng.choice([1e308, -1e308, 1e-300, 0.0, 5.0, rng.random(), float(rng.randrange(20))])) for _ in range(400)] + [("b", 2.0)] * 50 + [("c", None)] * 3 + [(None, float(i)) for i in range(30)] + [("d", tiny * i) for i in range(3)] * 5
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.share): r.value for r in evaluate.large_percentiles(df, ["k"], "x", [0.0, 0.5, 0.95, 1.0]).collect()}
    want = {}
    for k in {k for k, x in rows if x is not None}:
        held = sorted(x for g, x in rows if g == k and x is not None)
        want |= {(k, p): held[max(0, math.ceil(len(held) * p) - 1)] for p in (0.0, 0.5, 0.95, 1.0)}
    assert got == want
    assert [r.value for r in evaluate.large_percentiles(df.filter("k = 'a'"), [], "x", [0.5]).collect()] == [want["a", 0.5]]
    assert evaluate.large_percentiles(df.limit(0), ["k"], "x", [0.5]).count() == 0


@pytest.mark.parametrize("cell", [50_000, 5])
def test_quota_of_a_hot_stratum(spark, monkeypatch, cell):
    monkeypatch.setattr(sampling, "CELL_ROWS", cell)
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").otherwise("rare").alias("s"), F.col("id").alias("key"))
    got = {(r.s, r.key) for r in sampling.stratified(df, "s", "key", 777, "seed").collect()}
    quotas = {r.key: r.quota for r in sampling.largest_remainder(df.groupBy(F.col("s").alias("key")).agg(F.count("*").alias("n")), 777).collect()}
    ranked = df.withColumn("h", sampling.hash_rank("seed", F.col("key"))).collect()
    want = {(s, r.key) for s, q in quotas.items() for r in sorted((x for x in ranked if x.s == s), key=lambda x: (x.h, x.key))[:q]}
    assert got == want and len(got) == 777


def test_an_arm_that_fails_while_it_runs(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "alpha beta"), ("b", "beta gamma")], "chunk_id string, text string")
    index = inverted.build_index(chunks, f"{tmp_path}/i")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, "beta", [0.2, 0.9])], "query_id long, text string, qvec array<float>")
    assert {r.retrieval_mode for r in retrieval.retrieve("hybrid", index, vectors, asked, 2).collect()} == {"hybrid"}
    parts = list((tmp_path / "i" / "data").glob("*/postings/*.parquet"))
    for spoil in (lambda p: p.write_bytes(b"PAR1" + bytes(p.stat().st_size - 8) + b"PAR1"), lambda p: p.unlink()):  # a broken file, then a lost one
        for part in parts:
            spoil(part)
            part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
        got = retrieval.retrieve("hybrid", index, vectors, asked, 2).collect()
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == ["b", "a"] and {r.retrieval_mode for r in got} == {"dense_fallback"} and got[0].retrieval_error.startswith("bm25: ")
    alone = retrieval.retrieve("bm25", index, vectors, asked, 2).collect()
    assert [(r.chunk_id, r.retrieval_mode) for r in alone] == [(None, "failed")]


@pytest.mark.parametrize("arm", ["lexical", "dense"])
def test_hybrid_query_ends_when_an_arm_fails(spark, monkeypatch, arm):
    def fails(*_):
        return spark.range(1).select(F.raise_error(F.lit("no space left")).cast("long").alias("query_id"), F.lit("d0").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    monkeypatch.setattr(retrieval, arm, fails)
    with pytest.raises(Exception, match="no space left"):
        QUERIES["hybrid_rrf"](spark, "/root/testdata/sf0.001").collect()


def test_a_second_run_asks_no_model(spark, tmp_path):
    asked = []

    def call(missing):
        asked.append(sorted(r.text for r in missing.collect()))
        return missing.select("key", F.upper("text").alias("translation"))

    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id long, text string")
    one = {r.id: (r.translation, r.cached) for r in models.translate_through(texts, f"{tmp_path}/c", "de", call).collect()}
    assert one == {1: ("A", False), 2: ("B", False), 3: ("A", False), 4: (None, False), 5: ("", False)} and asked == [["", "a", "b"]]
    more = texts.unionByName(spark.createDataFrame([(6, "c")], texts.schema))
    two = {r.id: (r.translation, r.cached) for r in models.translate_through(more, f"{tmp_path}/c", "de", call).collect()}
    assert two[6] == ("C", False) and two[1] == ("A", True) and asked[1:] == [["c"]]
    three = models.translate_through(more, f"{tmp_path}/c", "de", call)
    assert three.filter("cached").count() == 5 and len(asked) == 2
    models.translate_through(texts, f"{tmp_path}/c", "fr", call).count()
    assert asked[2:] == [["", "a", "b"]]  # another language


def test_choice_in_rounds_and_chains(spark):
    """Random lists settle in rounds; in one chain of cases each waits for the one before."""
    rng = random.Random(9)
    lists = {c: rng.sample(range(400), 6) for c in range(300)} | {1000 + c: [5000 + c, 5001 + c, 5002 + c] for c in range(2000)}
    rows = [(c, f"c{c}", r, d) for c, docs in lists.items() for r, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "case_pos int, case_id string, rank int, doc int")
    used, want = set(), set()
    for c in sorted(lists):
        got = 0
        for d in lists[c]:
            if d not in used and got < 2:
                used.add(d)
                got += 1
                want.add((f"c{c}", d, got))
    assert {(r.case_id, r.doc, r.place) for r in sampling.hard_negatives(df).collect()} == want
    assert sampling.hard_negatives(df.limit(0)).count() == 0

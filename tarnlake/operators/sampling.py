"""Deterministic quotas, samples and splits (AG-22, SL-03 to SL-06, WN-09, WN-10, RT-21)."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.storage import stored

#: Rows of a stratum that are put in order together, about.
CELL_ROWS = 50_000
#: Rounds in which cases settle go on while each settles this share of them.
SETTLED_SHARE = 0.1


def hash_rank(seed: str, key: Column) -> Column:
    """First 16 hex digits of a hash: their order as text is their order as 64-bit numbers."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)


def largest_remainder(sizes: DataFrame, total: int) -> DataFrame:
    """AG-22: ``key, n`` to quotas that add up to ``total``; what is left over goes to the largest remainders, ties to the larger key.

    Whole numbers throughout, so no tie hangs on rounding.
    """
    every = Window.partitionBy()
    n, all_ = F.col("n").cast("long"), F.sum("n").over(every)
    out = sizes.withColumn("base", F.expr(f"n * {total}L div sum(n) OVER ()")).withColumn("rem", (n * total) % all_)
    place = F.row_number().over(Window.orderBy(F.col("rem").desc(), F.col("key").desc()))
    left = F.lit(total) - F.sum("base").over(every)
    return out.withColumn("place", place).withColumn("quota", (F.col("base") + F.when(F.col("place") <= left, 1).otherwise(0)).cast("long")).select("key", "n", "quota")


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """SL-03, SL-04: in each stratum the quota's rows with the smallest hash rank. Quotas are a handful of rows beside the table.

    Rows are counted by the first digits of their rank, so many that a stratum has about ``CELL_ROWS`` rows for each; cells below
    the one in which the quota ends are taken whole, and only that one is put in order.
    """
    quotas = largest_remainder(df.groupBy(F.col(stratum).alias("key")).agg(F.count("*").alias("n")), total)
    quotas = stored(df.sparkSession, quotas.select(F.col("key").alias(stratum), "n", "quota"), "quotas")
    largest = quotas.agg(F.max("n")).first()[0] or 0
    digits = 1
    while largest > CELL_ROWS * 16**digits and digits < 15:
        digits += 1
    ranked = df.withColumn("__rank", hash_rank(seed, F.col(key))).withColumn("__cell", F.substring("__rank", 1, digits))
    cells = ranked.groupBy(stratum, "__cell").agg(F.count("*").alias("__rows"))
    upto = F.sum("__rows").over(Window.partitionBy(stratum).orderBy("__cell"))
    # a row for each cell up to the quota: how many of its rows are wanted
    wanted = cells.withColumn("__before", upto - F.col("__rows")).join(quotas.select(stratum, "quota"), stratum).filter("__before < quota")
    wanted = wanted.select(stratum, "__cell", "__rows", F.least(F.col("quota") - F.col("__before"), F.col("__rows")).alias("__want"))
    held = ranked.join(wanted, [stratum, "__cell"])
    by = Window.partitionBy(stratum, "__cell").orderBy("__rank", key)
    cut = held.filter("__want < __rows").withColumn("__n", F.row_number().over(by)).filter("__n <= __want")
    return held.filter("__want = __rows").select(*df.columns).unionByName(cut.select(*df.columns))


def split_cases(cases: DataFrame, kind: str, key: str, quota: int, seed: str) -> DataFrame:
    """SL-05, WN-09: per kind the first ``quota`` by hash rank are for analysis, the rest for validation."""
    by = Window.partitionBy(kind).orderBy(hash_rank(seed, F.col(key)), key)
    return cases.withColumn("split", F.when(F.row_number().over(by) <= quota, "analysis").otherwise("validation"))


#: SL-05, fixed values: cases of each type for analysis and validation.
FORMAL_QUOTAS = {
    "basic": (105, 70), "semantic": (75, 50), "intra_document_reasoning": (24, 16), "project_related": (24, 16), "constrained": (18, 12),
    "completeness": (12, 8), "conflicting_info": (12, 8), "info_not_found": (12, 8), "miscellaneous": (12, 8), "high_level": (6, 4),
}


def formal_split(cases: DataFrame, kind: str, key: str, seed: str, quotas: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """SL-05: the split by fixed quotas per type; fails on blank or repeated ids, on other types and on another number of a type.

    The contract's table bounds the cases, so their counts are checked before anything is ranked.
    """
    quotas = FORMAL_QUOTAS if quotas is None else quotas
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    if not cases.filter(blank(key) | blank(kind)).isEmpty():
        raise ValueError("a case without id or type")
    if not cases.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("a case id occurs twice")
    found = {r[0]: r[1] for r in cases.groupBy(kind).count().limit(len(quotas) + 1).collect()}
    if found != {k: a + v for k, (a, v) in quotas.items()}:
        raise ValueError(f"types and their numbers differ from the contract: {found}")
    wanted = F.create_map(*[F.lit(x) for k, (a, _) in quotas.items() for x in (k, a)])
    by = Window.partitionBy(kind).orderBy(hash_rank(f"{seed}:case", F.col(key)), F.col(key).cast("string"))
    return cases.withColumn("split", F.when(F.row_number().over(by) <= wanted[F.col(kind)], "analysis").otherwise("validation"))


def ordinary_ids(docs: DataFrame, required: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """FL-04: a stratified sample of ``total`` of the documents that no case requires; null strata are one; too few are an error."""
    open_ = docs.select(key, F.coalesce(F.col(stratum), F.lit("unknown")).alias(stratum)).join(required.select(key), key, "left_anti")
    n = open_.count()
    if n < total:
        raise ValueError(f"{total} ordinary documents wanted, {n} are there")
    return stratified(open_, stratum, key, total, seed)


def corpus_ids(required: DataFrame, ordinary: DataFrame, hard: DataFrame, key: str) -> DataFrame:
    """SO-01: ids of all three roles, once each."""
    return required.select(key).union(ordinary.select(key)).union(hard.select(key)).distinct()


def first_per_kind(cases: DataFrame, kind: str, key: str, n: int = 1) -> DataFrame:
    """WN-10."""
    by = Window.partitionBy(kind).orderBy(key)
    return cases.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= n).drop("__n")


def split_faults(split: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """SO-05: keys in both parts, in neither, or unknown; empty for a sound split."""
    sides = split.groupBy(key).agg(F.count_distinct("split").alias("sides"))
    known = cases.select(key).distinct().withColumn("__known", F.lit(True))
    return known.join(sides, key, "full").filter("__known IS NULL OR sides IS NULL OR sides <> 1").select(key)


def twister_sample(spark: SparkSession, ids: list, n: int, seed: int) -> DataFrame:
    """SL-06: Python's generator over sorted ids, for small lists of ids that the caller holds."""
    return spark.createDataFrame([(i,) for i in random.Random(seed).sample(sorted(ids), n)], "id string")


def hard_negatives(top: DataFrame, per_case: int = 2, excluded: DataFrame | None = None) -> DataFrame:
    """RT-21: ``case_pos, case_id, rank, doc`` lists in case order; each case takes its first ``per_case`` documents that are not
    ``excluded`` (doc) and that no earlier case took.

    Cases settle in rounds: of each document that is not taken the first open case that lists it has the word, and a case whose
    next documents, as many as it still takes, are its own word each takes them. Rounds go on while they settle a good part of what is open; what is
    left then hangs together in long chains, where each case waits for the one before. Those that share documents form a
    group, groups are independent, and each is passed through in case order as its rows stream by.
    """
    open_ = top.select("case_pos", "case_id", "rank", "doc")
    if excluded is not None:
        open_ = open_.join(excluded.select("doc").distinct(), "doc", "left_anti")
    spark, done = top.sparkSession, []
    open_ = stored(spark, open_, "open-cases")
    cases = open_.select("case_pos").distinct().count()
    while cases:
        first = open_.groupBy("doc").agg(F.min("case_pos").alias("__first"))
        place = F.row_number().over(Window.partitionBy("case_pos").orderBy("rank"))
        said = open_.join(first, "doc").withColumn("__place", place).filter(F.col("__place") <= per_case)
        ready = said.groupBy("case_pos").agg(F.bool_and(F.col("__first") == F.col("case_pos")).alias("__ready")).filter("__ready").select("case_pos")
        taken = stored(spark, said.join(ready, "case_pos").select("case_pos", "case_id", "doc", F.col("__place").cast("int").alias("place")), "settled-cases")
        done.append(taken.select("case_id", "doc", "place"))
        open_ = stored(spark, open_.join(taken.select("case_pos").distinct(), "case_pos", "left_anti").join(taken.select("doc"), "doc", "left_anti").select(*open_.columns), "open-cases")
        before, cases = cases, open_.select("case_pos").distinct().count()
        if before - cases < before * SETTLED_SHARE:
            break
    if cases:
        done.append(_settled(open_, per_case))
    out = done[0] if done else _settled(open_, per_case)
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _settled(lists: DataFrame, per_case: int) -> DataFrame:
    """Cases whose lists share documents form groups; each group is passed through in case order, on its own."""
    spark = lists.sparkSession
    shared = lists.groupBy("doc").agg(F.count_distinct("case_pos").alias("n"), F.min("case_pos").alias("head")).filter("n > 1")
    edges = lists.join(shared, "doc").filter("case_pos <> head").select(F.col("case_pos").alias("a"), F.col("head").alias("b")).distinct()
    label = _groups(spark, lists.select(F.col("case_pos").alias("node")).distinct(), edges)
    grouped = lists.join(label.select(F.col("node").alias("case_pos"), "label"), "case_pos")

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = case = None
        used: set = set()
        got = 0
        for frame in frames:
            keep = []
            for g, c, name, doc in zip(frame["label"], frame["case_pos"], frame["case_id"], frame["doc"], strict=True):
                if g != group:
                    group, case, used, got = g, None, set(), 0
                if c != case:
                    case, got = c, 0
                if got < per_case and doc not in used:
                    used.add(doc)
                    got += 1
                    keep.append((name, doc, got))
            yield pd.DataFrame(keep, columns=["case_id", "doc", "place"])

    kinds = dict(lists.dtypes)
    ordered = grouped.repartition("label").sortWithinPartitions("label", "case_pos", "rank")
    return ordered.mapInPandas(take, f"case_id {kinds['case_id']}, doc {kinds['doc']}, place int")


def _groups(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label`` with the smallest node reachable, by taking on smaller labels until none changes.
    """
    both = stored(spark, edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "case-edges")
    label = nodes.withColumn("label", F.col("node"))
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        low = label.join(near, "node", "left").select("node", F.least("label", "l").alias("low"), "label")
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = low.join(up, "low").select("node", F.least("low", "up").alias("label"), F.col("label").alias("was"))
        new = stored(spark, new, "case-labels")
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")

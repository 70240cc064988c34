"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, piecewise linear. Its integral gives the source's
cumulative token demand. The documents of a source, in a seeded order and over as many passes as the target asks
for, lie one after the other on that demand; inverting the demand at a document's first word gives its position in
training. Sorting by position (a range partitioning) yields the mixed stream.

Targets: the mix has ``budget`` times the corpus's words; sources share it by weight, but no source is taken more than
``cap`` times; what is above a cap goes to the others by weight. With x the level at which ``sum(min(cap * size, x *
weight))`` meets the budget, a source's target is ``min(cap * size, x * weight)``; x is found by one pass over the
sources in order of ``cap * size / weight``.

Running totals within a source are taken in steps (totals of hash buckets, by thousands of buckets first, then inside
each bucket), so that a source that holds a third of all rows is spread over many tasks.

Defined cases: a null source is a source of its own, last in order; a null or empty text has size 0, is taken 0 words
and has a null position; repeated rows count each for itself; ties in the seeded order fall to ``doc_id``; an empty
table gives no rows; :func:`mix` keeps extra columns whatever their names, but for ``pass, words, position``, its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpointed, sums_before

WORD = r"[^\x20\x09-\x0D]+"
#: Knots (time, factor) of the curricula that sources follow in turn: early, even, late. A factor scales the weight.
CURRICULA = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: Rows that share a source and a hash bucket, about.
BUCKET_ROWS = 500


def _literal(curricula: Sequence) -> Column:
    """array per curriculum of segments (begin, span, w0, w1, area before), areas scaled to a total of 1."""
    out = []
    for knots in curricula:
        area, segments = 0.0, []
        for (a, v), (b, w) in zip(knots, knots[1:], strict=False):
            segments.append((a, b - a, v, w, area))
            area += (b - a) * (v + w) / 2
        out.append([(a, d, v / area, w / area, s / area) for a, d, v, w, s in segments])
    row = lambda s: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(s, ("at", "span", "w0", "w1", "area"), strict=True)])
    return F.array(*[F.array(*[row(s) for s in c]) for c in out])


def time_at(share: Column, segments: Column) -> Column:
    """The time by which the share of its demand has been met: the inverse of the integrated schedule."""
    s = F.element_at(F.filter(segments, lambda x: x["area"] <= share), -1)
    y = share - s["area"]
    slope = (s["w1"] - s["w0"]) / s["span"]
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * y, F.lit(0.0)))
    step = F.when(s["w0"] + root > 0, 2 * y / (s["w0"] + root)).otherwise(0.0)
    return F.least(s["at"] + F.least(step, s["span"]), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """``sizes`` has ``skey, source_size`` (one row a source); adds ``ordinal, target``."""
    order = F.row_number().over(Window.orderBy("skey")) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("ordinal"), F.lit(len(weights))).cast("int") + 1)
    by = Window.orderBy("ratio", "ordinal")
    everything = Window.partitionBy()
    out = sizes.withColumn("ordinal", order).withColumn("weight", given).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn("capped_before", F.sum("most").over(by) - F.col("most")).withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by) + F.col("weight"))
    out = out.withColumn("level", (budget * F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_left"))
    # the first source in order of ratio whose level does not reach its cap fixes the level for all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "ordinal", "level"))).over(everything)["level"]
    return out.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))).select("skey", "ordinal", "source_size", "target")


def mix_plan(spark: SparkSession, docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, curricula: Sequence = CURRICULA, seed: int = 11, bucket_rows: int = BUCKET_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id, <keep>, size, source_size, target, taken, uses``.

    ``uses`` lists the passes that take the document: (pass, words, position). ``taken`` is the sum of their words.
    A source's taken words equal its rounded target; only the document at the end of the last pass is cut.
    """
    n = max(1, -(-docs.count() // bucket_rows))
    skey = F.when(F.col("source").isNotNull(), F.concat(F.lit("a"), F.col("source"))).otherwise("b")
    sized = docs.select("doc_id", *keep, skey.alias("skey"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.crc32("text")).alias("mark"))
    sized = sized.withColumn("part", F.pmod("mark", F.lit(n)))
    parts = checkpointed(spark, sized.groupBy("skey", "part").agg(F.sum("size").alias("part_size")))
    targets = source_targets(parts.groupBy("skey").agg(F.sum("part_size").alias("source_size")), weights, budget, cap)
    placed = sums_before(parts, "part", "part_size", by="skey").select("skey", "part", "before").join(targets, "skey")
    inside = F.sum("size").over(Window.partitionBy("skey", "part").orderBy("mark", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    out = sized.withColumn("inside", F.coalesce(inside, F.lit(0))).join(placed, ["skey", "part"])
    begin = F.col("before") + F.col("inside")
    goal = F.round("target").cast("long")
    segments = F.element_at(_literal(curricula), F.pmod(F.col("ordinal"), F.lit(len(curricula))).cast("int") + 1)

    def use(k: Column) -> Column:
        at = k * F.col("source_size") + F.col("begin")
        words = F.greatest(F.least(F.col("size"), F.col("goal") - at), F.lit(0))
        return F.struct(k.cast("int").alias("pass"), words.cast("long").alias("words"), time_at(F.coalesce(F.try_divide(at, F.col("goal")), F.lit(0.0)), segments).alias("position"))

    passes = F.sequence(F.lit(0), F.lit(max(0, int(-(-cap // 1)) - 1)))
    out = out.withColumn("begin", begin).withColumn("goal", goal)
    out = out.withColumn("uses", F.filter(F.transform(passes, use), lambda u: u["words"] > 0))
    return out.withColumn("taken", F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"])).select("doc_id", *keep, "size", "source_size", "target", "taken", "uses")


def mix(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mixed stream: a row for each use of a document, sorted by training ``position``; a cut use ends after its last word."""
    columns = [c for c in docs.columns if c not in ("pass", "words", "position")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("row")  # the text travels once
    plan = mix_plan(spark, docs.select("doc_id", "source", "text", row), keep=["text", "row"], **how)
    uses = plan.select("doc_id", "text", "row", "size", F.explode("uses").alias("use"))
    whole = F.col("use.words") >= F.col("size")
    # the text up to the end of its last word taken, with its own white space: what a split that stops there leaves goes
    n = F.col("use.words").cast("int") + F.when(F.col("text").rlike(r"\A[\x20\x09-\x0D]"), 2).otherwise(1)
    rest = F.element_at(F.split("text", r"[\x20\x09-\x0D]+", n), -1)
    cut = F.regexp_replace(F.left("text", F.length("text") - F.length(rest)), r"[\x20\x09-\x0D]+\z", "")
    text = F.when(whole, F.col("text")).otherwise(cut)
    stream = uses.select("doc_id", text.alias("text"), "row", F.col("use.pass").alias("pass"), F.col("use.words").alias("words"), F.col("use.position").alias("position"))
    ordered = stream.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in columns], "pass", "words", "position")

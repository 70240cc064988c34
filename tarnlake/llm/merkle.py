"""Merkle manifest of a data set: a digest for each row, for each source and for all, with a proof of membership for each row.

Rows become leaves, the leaves of a source ascend by ``doc_id``, and every ``ARITY`` consecutive nodes become one until one is
left, the source's subroot; subroots in the order of sources become the root in the same way. As the number of a tree's leaves
is known, so is the number of children of each of its nodes.

The forest is built by an associative (and commutative) monoid. A :class:`Forest` holds unresolved nodes keyed by tree, level
and index; to merge two is to put their nodes together, and whenever all siblings of a run are there they become their parent.
Tasks that read a stretch of the numbered leaves write the nodes they resolve and leave a few per level open at either end of
the stretch. Open nodes are merged first in about the square root of as many stretches, then by ``treeReduce``, whose result
holds the root and the nodes over the borders of stretches: a few for each level and task, never the leaves. Proofs go down the
levels by joins on (tree, run); a run has ``ARITY`` rows at most, so a hot source has no hot key.

Texts are read once, to be hashed; only digests are sorted. Leaves are numbered by a range sort with a row's place in its input
as the last key, so that rows equal in every column can be split as well, and by running totals of a row per partition and source.

Defined cases: a null column hashes as ``-``, an empty one as ``0:``; null sources are one source and the first, null ``doc_id`` are
the first of their source; rows that share source and ``doc_id`` are a leaf each, in the order of their leaf digests; a source of
one row has its leaf for a subroot, a data set of one source the subroot for a root; very long texts are one row; columns other than
those hashed play no part; an empty table gives no rows and no root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import crc32_sql, released, sums_before, written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots.
TOP = -1


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // ARITY)
        levels += 1
    return levels


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Unresolved nodes of any trees, and what has been resolved on the way.

    ``open``: (tree, leaves of the tree, level, run) -> index -> digest. ``closed``: (tree, level, index, digest) of nodes that have
    become part of their parent. ``trees``: leaves of the tree over the subroots.
    """

    def __init__(self, trees: int) -> None:
        self.trees, self.open, self.closed, self.root = trees, {}, [], None

    def add(self, tree: int, leaves: int, level: int, index: int, value: str) -> None:
        while True:
            wide = -(-leaves // ARITY**level)  # nodes on this level
            if wide == 1:
                self.closed.append((tree, level, index, value))
                if tree == TOP:
                    self.root = value
                    return
                tree, leaves, level, index = TOP, self.trees, 0, tree
                continue
            run = index // ARITY
            key = (tree, leaves, level, run)
            siblings = self.open.setdefault(key, {})
            siblings[index] = value
            if len(siblings) < min(ARITY, wide - run * ARITY):
                return
            del self.open[key]
            ordered = sorted(siblings.items())
            self.closed += [(tree, level, k, v) for k, v in ordered]
            level, index, value = level + 1, run, digest(v for _, v in ordered)

    def nodes(self) -> Iterator[tuple[int, int, int, int, str]]:
        """tree, leaves, level, index, digest of what is open."""
        for (tree, leaves, level, _), siblings in self.open.items():
            for index, value in siblings.items():
                yield tree, leaves, level, index, value

    def merge(self, other: Forest) -> Forest:
        one, two = (self, other) if len(self.open) + len(self.closed) >= len(other.open) + len(other.closed) else (other, self)
        one.closed += two.closed
        one.root = one.root or two.root
        for node in two.nodes():
            one.add(*node)
        return one


def hashed(fields: Sequence[Column]) -> Column:
    """Digest of a row: each value by its length in bytes and itself, or ``-``."""
    parts = []
    for c in fields:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """``leaves``: doc_id, source, leaf, the columns kept, tree, pos, n. ``nodes``: tree, level, index, digest of all inner nodes and subroots. ``root``, ``trees``, ``largest``: its digest, how many sources, leaves of the largest."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    trees: int
    largest: int


_NODES = "tree long, level int, index long, digest string"


def _numbered(spark: SparkSession, leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Leaves with ``tree`` (number of the source), ``pos`` and ``n`` (of its leaves), sorted by stretches; number of trees, leaves of the largest."""
    order = ["source", "doc_id", "leaf", "__tie"]
    tied = leaves.withColumn("__tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    placed = written(spark, placed.withColumn("__part", F.spark_partition_id().cast("long")).withColumn("__at", F.monotonically_increasing_id()), "leaves-in-order")
    cells = placed.groupBy("__part", "source").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    of_source = Window.partitionBy("source").orderBy("__part")
    cells = cells.withColumn("__before", F.sum("__n").over(of_source) - F.col("__n")).withColumn("n", F.sum("__n").over(Window.partitionBy("source")))
    cells = written(spark, cells.withColumn("__begins", (F.col("__before") == 0).cast("long")), "leaves-cells")
    begun = sums_before(cells.groupBy("__part").agg(F.sum("__begins").alias("__b")), "__part", "__b").select("__part", F.col("before").alias("__earlier"))
    # a source that goes on from an earlier partition is the first of its partition
    inside = F.sum("__begins").over(Window.partitionBy("__part").orderBy("source"))
    cells = cells.withColumn("__inside", inside).join(begun, "__part").withColumn("tree", F.col("__earlier") + F.col("__inside") - 1)
    cells = written(spark, cells.select("__part", F.col("source").alias("__source"), "n", "tree", (F.col("__before") - F.col("__first")).alias("__shift")), "leaves-ranks")
    trees, largest = cells.agg(F.max("tree"), F.max("n")).first()
    joined = placed.join(cells, (placed["__part"] == cells["__part"]) & placed["source"].eqNullSafe(cells["__source"]))
    joined = joined.select(*leaves.columns, "tree", (F.col("__at") + F.col("__shift")).alias("pos"), "n")
    joined = joined.repartitionByRange("tree", "pos").sortWithinPartitions("tree", "pos")
    return written(spark, joined, "leaves-numbered"), 0 if trees is None else trees + 1, largest or 0


def build(spark: SparkSession, docs: DataFrame, *, fields: Sequence[str] = FIELDS, keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``keep`` are further columns that travel with the leaves."""
    keep = keep or {}
    row = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), hashed([F.col(f"`{c}`") for c in fields]).alias("leaf"), *[c.alias(k) for k, c in keep.items()])
    leaves, trees, largest = _numbered(spark, written(spark, row, "leaves"))

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple], still_open: bool) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], pa.array([still_open] * len(found), pa.bool_())], ["tree", "leaves", "level", "index", "digest", "open"])

        forest = Forest(trees)
        for batch in batches:
            for tree, pos, n, leaf in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                forest.add(tree, n, 0, pos, leaf)
            # leaves are in their own table already, but for a subroot that is a leaf
            yield rows([(t, 0, level, k, v) for t, level, k, v in forest.closed if level or t == TOP], False)
            forest.closed = []
        yield rows(list(forest.nodes()), True)

    made = leaves.select("tree", "pos", "n", "leaf").mapInArrow(released(stretch), "tree long, leaves long, level int, index long, digest string, open boolean")
    made = written(spark, made, "nodes")
    still = made.filter("open")
    stretches = max(1, math.isqrt(leaves.rdd.getNumPartitions()))
    first = F.col("index") * F.pow(F.lit(float(ARITY)), F.col("level"))
    ordered = still.withColumn("a", F.when(F.col("tree") == TOP, first).otherwise(F.col("tree"))).withColumn("b", F.when(F.col("tree") == TOP, 0.0).otherwise(first))
    ordered = ordered.repartitionByRange(stretches, "a", "b").select("tree", "leaves", "level", "index", "digest")

    def fragment(found: Iterator) -> Iterator[Forest]:
        forest = Forest(trees)
        for node in found:
            forest.add(*node)
        yield forest

    whole = ordered.rdd.mapPartitions(fragment).treeReduce(Forest.merge) if trees else Forest(0)
    inner = [x for x in whole.closed if x[1] or x[0] == TOP]
    nodes = made.filter(~F.col("open")).select("tree", "level", "index", "digest").unionByName(spark.createDataFrame(inner, _NODES))
    root = whole.root
    if trees and root is None:  # one task resolved everything
        root = nodes.filter((F.col("tree") == TOP) & (F.col("level") == height(trees))).first()["digest"]
    return Manifest(leaves, nodes, root, trees, largest)


def _level(df: DataFrame, run: str, kids: str) -> DataFrame:
    """A row for each member of ``kids`` with ``step``: the digests left and right of it in its run."""
    digests = F.transform(kids, lambda k: k["digest"])
    out = df.withColumn("__digests", digests).select("*", F.posexplode(kids).alias("__i", "__kid")).drop(kids)
    left = F.array_join(F.slice("__digests", F.lit(1), F.col("__i")), "")
    right = F.array_join(F.slice("__digests", F.col("__i") + 2, F.lit(ARITY)), "")
    return out.withColumn("step", F.struct(left.alias("left"), right.alias("right"))).drop("__digests", run)


def proofs(made: Manifest) -> DataFrame:
    """``made.leaves`` with ``subroot`` and ``path array<struct<left, right>>``: the siblings on the way to the root."""
    runs = made.nodes.groupBy("tree", "level", F.floor(F.col("index") / ARITY).alias("run")).agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("kids"))

    def down(level: int, parents: DataFrame, of_top: bool) -> DataFrame:
        """Paths of the nodes on ``level`` from those of their parents."""
        here = runs.filter((F.col("level") == level) & ((F.col("tree") == TOP) if of_top else (F.col("tree") != TOP)))
        held = _level(here.join(parents.withColumnRenamed("index", "run"), ["tree", "run"]), "run", "kids")
        return held.select("tree", F.col("__kid.index").alias("index"), F.col("__kid.digest").alias("digest"), F.concat(F.array("step"), "path").alias("path"), *[c for c in parents.columns if c not in ("tree", "index", "digest", "path")])

    spark = made.leaves.sparkSession
    steps = "array<struct<left: string, right: string>>"
    above = height(made.trees)
    top = spark.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("index"), F.lit(made.root).alias("digest"), F.array().cast(steps).alias("path"))
    for level in reversed(range(above)):
        top = down(level, top.drop("digest"), True)
    # a subroot's path is that of its leaf in the tree over subroots
    sizes = made.leaves.filter("pos = 0").select("tree", "n")
    subroots = top.select(F.col("index").alias("tree"), F.lit(0).cast("long").alias("index"), F.col("digest").alias("subroot"), "path").join(sizes, "tree")
    high = sum(((F.col("n") > ARITY**k).cast("int") for k in range(height(made.largest))), F.lit(0))
    subroots = subroots.withColumn("h", high)
    subroots = written(spark, subroots, "subroots")
    highest = height(made.largest)
    paths = subroots.filter(F.col("h") == highest).select("tree", "index", "subroot", "path")
    for level in reversed(range(1, highest)):
        paths = down(level, paths, False).drop("digest").unionByName(subroots.filter(F.col("h") == level).select("tree", "index", "subroot", "path"))
    if highest:
        paths = paths.unionByName(subroots.filter("h = 0").select("tree", "index", "subroot", "path"))
    keep = [c for c in made.leaves.columns if c not in ("tree", "pos", "n")]
    kid = F.struct("pos", F.col("leaf").alias("digest"), F.struct(*keep).alias("row"))
    lowest = made.leaves.groupBy("tree", F.floor(F.col("pos") / ARITY).alias("run"), "n").agg(F.array_sort(F.collect_list(kid), lambda a, b: F.when(a["pos"] < b["pos"], -1).otherwise(F.when(a["pos"] > b["pos"], 1).otherwise(0))).alias("kids"))
    held = _level(lowest.join(paths.withColumnRenamed("index", "run"), ["tree", "run"]), "run", "kids")
    path = F.when(F.col("n") > 1, F.concat(F.array("step"), "path")).otherwise(F.col("path"))
    return held.select("__kid.row.*", "subroot", path.alias("path"))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: str = "path") -> Column:
    """Digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audit(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Manifest of ``docs``, and how each row folds to the root when every fifth, by the checksum of its id, has its text in lower case."""
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = hashed([F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS])
    made = build(spark, docs, keep={"tampered": F.when(picked, changed)})
    if not made.trees:
        kind = dict(docs.dtypes)["doc_id"]
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = proofs(made).withColumn("root", F.lit(made.root)).withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, nodes: str, rows: str, levels: int) -> str:
    """CTEs that build the trees over ``nodes`` (tree, idx, d, m: of the tree) level by level and take ``rows`` (key, tree, idx, fold, path) up to ``{name}_end``."""
    out = [f"{name}_n0 AS (SELECT tree, idx, d, m FROM {nodes})", f"{name}_p0 AS (SELECT key, tree, idx, fold, path FROM {rows})"]
    left, right = f"array_to_string(r.kids[1:p.idx % {ARITY}], '')", f"array_to_string(r.kids[p.idx % {ARITY} + 2:], '')"
    for k in range(levels):
        out.append(f"{name}_r{k} AS (SELECT tree, idx // {ARITY} AS run, list(d ORDER BY idx) AS kids, any_value(m) AS m FROM {name}_n{k} GROUP BY tree, idx // {ARITY})")
        out.append(f"{name}_n{k + 1} AS (SELECT tree, run AS idx, CASE WHEN m = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS d, (m + {ARITY - 1}) // {ARITY} AS m FROM {name}_r{k})")
        out.append(f"{name}_p{k + 1} AS (SELECT key, p.tree, p.idx // {ARITY} AS idx, CASE WHEN r.m = 1 THEN p.fold ELSE sha256({left} || p.fold || {right}) END AS fold, p.path || {left} || {right} AS path FROM {name}_p{k} p JOIN {name}_r{k} r ON p.tree = r.tree AND p.idx // {ARITY} = r.run)")
    out.append(f"{name}_end AS (SELECT key, p.tree, p.fold, p.path, n.d AS top FROM {name}_p{levels} p JOIN {name}_n{levels} n ON p.tree = n.tree)")
    return ", ".join(out)


_SIZED = {c: f"strlen({c}::VARCHAR) || ':' || {c}" for c in FIELDS}
_LEAF = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE {sized} END" for c, sized in _SIZED.items())
_CHANGED = _LEAF.replace(_SIZED["text"], f"strlen(text) || ':' || translate(text, '{_UPPER}', '{_LOWER}')")
#: Six levels either way hold 16 million leaves.
OP13_SQL = f"""
WITH leaf AS (
  SELECT doc_id, source, sha256({_LEAF}) AS d, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256({_CHANGED}) END AS t FROM documents
), placed AS (
  SELECT *, row_number() OVER () AS key, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY source) AS m FROM leaf
), held AS MATERIALIZED (SELECT * FROM placed), low AS (SELECT key, tree, idx, coalesce(t, d) AS fold, '' AS path FROM held),
{_tree_sql("s", "held", "low", 6)},
subs AS (SELECT 0 AS tree, tree AS idx, any_value(top) AS d, count(*) OVER () AS m FROM s_end GROUP BY tree),
above AS (SELECT key, 0 AS tree, tree AS idx, fold, path FROM s_end),
{_tree_sql("u", "subs", "above", 6)}
SELECT h.doc_id, h.d AS leaf, s.top AS subroot, u.top AS root, sha256(u.path) AS proof_sha256, u.fold AS folded_root, u.fold = u.top AS verified
FROM held h JOIN s_end s USING (key) JOIN u_end u USING (key)
"""

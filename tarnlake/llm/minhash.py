"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles as 64-bit hashes. The sketch has 256 bins. In round i each
element is placed in one bin with a hashed value; a bin keeps the smallest (round, value). Rounds go on until every
bin is filled; those from 256 on aim at one bin each, so every bin fills whatever the size of the set. Two sets agree in a bin
with a probability equal to their similarity, and agreement concentrates like independent draws. The bands follow from
the threshold: as many bins a band as still miss a pair at the threshold with probability below 1e-6 (at 0.85
36 bands of 7, at 0.8 51 of 5). Below 0.06 even bands of one bin miss more.

Equal sets are found by their digest first and take part once. Sets that share a band are candidates; every link
is confirmed on the full sets. Pairs are never written out: candidates that hang together through shared bands form a
family, and a task compares a whole family at a time by counting common shingles through an inverted list, returning the few
links that connect it. Of a family of too many shingles for one task, blocks of members are compared with ``PIVOTS`` of its
members first, in one pass; what is linked to the same pivots is in one component and needs no comparison among
itself. Members outside the family's largest component so found are then compared with all members of the family, or
with all that share a band with them, whichever is less, in blocks. Within a group a set is compared with all others;
what is left when all sets not yet compared lie in one component needs no comparison. Components are labelled by minimum label with pointer jumping; every table of a round is written to the
shared folder. Joins by band, family, block and label send keys with over a 200th of the rows by broadcast (at most 200).

Defined cases: a null or empty text has an empty set and is linked with nothing; with fewer than five words the
whole sequence is the one shingle; rows that share a ``doc_id`` count as one document; rows with a null ``doc_id``
take no part (null component, kept); a ``doc_id`` that is no whole number is refused; repeated rows get equal results; ties fall to the smaller ``doc_id``; an empty table
gives no rows; further columns are ignored or, by :func:`drop_near_copies`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import give_back, join_counted, released, written

SHINGLE = 5
BINS = 256
#: Probability to miss a pair at the threshold.
MISSED = 1e-6
#: A task compares sets of about this many shingles together, and blocks of about so many with pivots or with one another. A text
#: weighs its distinct shingles, or its bytes by ``SHINGLE_BYTES`` where it repeats itself, as texts travel and not sets.
SHINGLE_BYTES = 8
GROUP_SHINGLES = 100_000
STAR_SHINGLES = 20_000
PIVOTS = 8
#: A worker gives memory back after a group of more than this many.
RELEASED_SHINGLES = 300_000
#: Up to this many candidates (tens of MB) are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000
WORD_MEMO = 250_000

_U = np.uint64
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_ROUNDS = np.random.default_rng(3).integers(1, 2**63, 2 * BINS, dtype=np.uint64)
_BAND_WEIGHTS = np.random.default_rng(4).integers(1, 2**63, BINS, dtype=np.uint64) | _U(1)
_EDGES = np.arange(BINS, dtype=np.uint64) << _U(56)
_LOW = _U((1 << 46) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower and bytes.split know just A-Z and the six ASCII blanks."""
    parts = text.encode("utf-8").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(SHINGLE, len(parts))
    total = np.full(len(parts) - n + 1, n, np.uint64)
    for i in range(n):
        total += mix(h[i : len(h) - n + 1 + i] * _WEIGHTS[i])
    return np.unique(mix(total))


def sketch(elements: np.ndarray, *, bins: int = BINS) -> np.ndarray:
    """For each bin the smallest (round, value), packed into 64 bits under the bin's number. ``elements`` are sorted."""
    out = np.zeros(bins, np.uint64)
    empty = np.ones(bins, bool)
    done, n = 0, len(elements)
    while done < bins and empty.any():
        rounds = min(bins - done, 1 if n > 6 * bins else max(1, int(1.2 * bins * np.log(bins)) // n))
        if done == 0 and rounds == 1:
            h = (elements & _EDGES[-1]) | ((elements >> _U(10)) & _LOW)
        else:
            h = mix(elements[None, :] ^ _ROUNDS[done : done + rounds, None])
            if done == 0:
                h[0] = elements
            h = np.sort(((h & _EDGES[-1]) | (np.arange(done, done + rounds, dtype=np.uint64)[:, None] << _U(46)) | ((h >> _U(10)) & _LOW)).ravel())
        at = np.searchsorted(h, _EDGES)
        at[at == len(h)] = 0
        first = h[at]
        new = empty & ((first & _EDGES[-1]) == _EDGES)
        out[new] = first[new]
        empty &= ~new
        done += rounds
    for b in np.flatnonzero(empty):
        out[b] = (_U(b) << _U(56)) | (_U(bins + b) << _U(46)) | (mix(elements ^ _ROUNDS[bins + b]).min() >> _U(18) & _LOW)
    return out


def band_rows(percent: int) -> int:
    """Bins a band: the most with which a pair at ``percent`` similarity is missed with a probability below ``MISSED``."""
    return next((r for r in range(BINS, 1, -1) if (1 - (percent / 100) ** r) ** (BINS // r) < MISSED), 1)


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` bins; equal keys mean equal bins there."""
    n = BINS // rows
    mixed = mix(values[: n * rows]) * _BAND_WEIGHTS[: n * rows]
    return mix(mixed.reshape(n, rows).sum(axis=1, dtype=np.uint64))


def features(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, weight, set_a, set_b, bands``: size, cost, digest and band keys of each document's set."""
    width = band_rows(percent)
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}: number the documents and join their names afterwards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                size, weight, a, b, keys, ends = [], [], [], [], [], [0]
                for text in part.column(1).to_pylist():
                    s = shingles(text, words)
                    size.append(len(s))
                    weight.append(max(len(s), len(text.encode()) // SHINGLE_BYTES if text else 0))
                    digest = xxhash.xxh3_128_digest(s)
                    a.append(int.from_bytes(digest[:8], "little", signed=True))
                    b.append(int.from_bytes(digest[8:], "little", signed=True))
                    if len(s):
                        keys.append(bands(sketch(s), width))
                    ends.append(len(keys) * (BINS // width))
                flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(weight, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["doc_id", "n_shingles", "weight", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, n_shingles long, weight long, set_a long, set_b long, bands array<long>")


def connecting_links(sets: list[np.ndarray], percent: int, known: list[int | None] | None = None) -> list[tuple[int, int]]:
    """Links (places in ``sets``) whose components are those of all links among ``sets``; sets of one ``known`` label are connected already."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), sizes)
    _, which, df = np.unique(flat, return_inverse=True, return_counts=True)
    often = df > 1  # a shingle of one set alone is common to no pair
    posted = owner[np.argsort(which, kind="stable")]
    ends = np.cumsum(df)
    begins = ends - df
    at = np.concatenate(([0], np.cumsum(sizes)))
    mine = [(w := which[at[i] : at[i + 1]])[often[w]] for i in range(n)]
    # no link without enough shingles that others have
    waiting = np.array([100 * len(m) >= percent * k for m, k in zip(mine, sizes, strict=True)])
    label, found = np.arange(n), []
    first: dict[int, int] = {}
    for i, name in enumerate(known or []):
        if name is not None:
            label[i] = first.setdefault(name, i)
    while waiting.any():
        left = np.flatnonzero(waiting)
        names, count = np.unique(label[left], return_counts=True)
        if len(names) == 1:
            break
        outside = left[label[left] != names[count.argmax()]]
        i = int(outside[0])
        waiting[i] = False
        common = np.bincount(np.concatenate([posted[begins[w] : ends[w]] for w in mine[i]]), minlength=n)
        linked = np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common))
        for j in linked:
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def _linked(percent: int):
    """Grouped form: texts of one group in, connecting links out."""

    def run(table: pa.Table) -> pa.Table:
        words = _Words()
        ids, sets, known = [], [], []
        for rep, text, label in zip(table.column("rep").to_pylist(), table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True):
            s = shingles(text, words)
            if len(s):
                ids.append(rep)
                sets.append(s)
                known.append(label)
        links = connecting_links(sets, percent, known) if sets else []
        return _links([(ids[i], ids[j]) for i, j in links], sets)

    return run


def _linked_to_pivots(percent: int):
    """Grouped form: texts of one block and of the family's pivots in, links between both out."""

    def run(table: pa.Table) -> pa.Table:
        words = _Words()
        rows = list(zip(table.column("rep").to_pylist(), table.column("pivot").to_pylist(), [shingles(t, words) for t in table.column("text").to_pylist()], strict=True))
        pivots = [(rep, s) for rep, pivot, s in rows if pivot]
        links = []
        for rep, pivot, s in rows:
            for head, t in [] if pivot else pivots:
                common = len(np.intersect1d(s, t, assume_unique=True)) if head != rep else 0
                if common and 100 * common >= percent * (len(s) + len(t) - common):
                    links.append((head, rep))
        return _links(links, [s for _, _, s in rows])

    return run


def _links(links: list[tuple[int, int]], sets: list[np.ndarray]) -> pa.Table:
    if sum(map(len, sets)) > RELEASED_SHINGLES:
        sets.clear()
        give_back()
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node, label`` of every node in ``edges`` (a, b): the smallest node reachable."""
    both = written(spark, edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    ends = both.count()
    labels = written(spark, both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"), F.count("*").alias("degree")), "labels")
    nodes = labels.count()
    while True:
        # the least label next to a node; a node with many neighbours is sent to them
        near = join_counted(both, labels.select(F.col("node").alias("other"), "label", "degree"), ["other"], "degree", ends, "inner").groupBy("node").agg(F.min("label").alias("near"))
        lower = written(spark, labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"), "degree"), "lower")
        # and the label that its label has by now
        under = lower.groupBy("low").agg(F.count("*").alias("under"))
        up = under.join(lower.select(F.col("node").alias("low"), F.col("low").alias("up")), "low")
        labels = written(spark, join_counted(lower, up, ["low"], "under", nodes, "inner").select("node", F.least("low", "up").alias("label"), "was", "degree"), "labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("was")


def _fetched(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` rows with the text of their ``rep``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    return texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_CANDIDATES else asked, "rep")


def _links_of_large(spark: SparkSession, docs: DataFrame, reps: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Connecting links of the families in ``reps`` (family, rep, n, weight), each too large for a task."""
    total = reps.count()
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    placed = reps.select("family", part(F.ceil(F.col("weight") / STAR_SHINGLES)).alias("i"), "rep", F.lit(False).alias("pivot"))
    pivots = reps.groupBy("family", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(PIVOTS)).alias("p")).agg(F.min("rep").alias("rep"))
    heads = placed.select("family", "i").distinct().join(pivots, "family").select("family", "i", "rep", F.lit(True).alias("pivot"))
    asked = written(spark, placed.union(heads), "pivot-candidates")
    stars = written(spark, _fetched(docs, asked).groupBy("family", "i").applyInArrow(_linked_to_pivots(percent), "a long, b long"), "pivot-links").distinct()
    known = components(spark, stars).withColumnRenamed("node", "rep")
    labelled = written(spark, reps.select("rep", "n", "family").join(known, "rep", "left"), "labelled")
    sizes = labelled.groupBy("family", "label").agg(F.count("*").alias("members")).groupBy("family").agg(F.sum("members").alias("size"), F.max(F.when(F.col("label").isNotNull(), F.struct("members", (-F.col("label")).alias("below")))).alias("main"))
    marked = join_counted(labelled, sizes.select("family", "size", (-F.col("main.below")).alias("largest")), ["family"], "size", total, "inner")
    marked = written(spark, marked.withColumn("loose", ~F.coalesce(F.col("label") == F.col("largest"), F.lit(False))).drop("largest"), "marked")
    # members outside the largest component meet their whole family, or all that share a band with them
    rows = members.select("band", "rep").join(marked, "rep")
    held = written(spark, rows.select("family", F.lit(1).alias("kind"), F.col("band").alias("unit"), "rep", "n", "label", "loose").union(marked.select("family", F.lit(0), "family", "rep", "n", "label", "loose")), "units")
    units = held.groupBy("family", "kind", "unit").agg(F.count("*").alias("size"), F.count_if("loose").alias("asking"), F.ceil(F.sum("n") / STAR_SHINGLES).cast("int").alias("blocks"), F.ceil(F.sum(F.when(F.col("loose"), F.col("n"))) / STAR_SHINGLES).cast("int").alias("rounds"))
    units = written(spark, units.filter("asking > 0 AND size > 1"), "asking-units")
    cost = F.col("size") * F.col("rounds") + F.col("asking") * F.col("blocks")
    by_kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, cost)), F.lit(0))
    best = units.groupBy("family").agg((by_kind(1) < by_kind(0)).cast("int").alias("best"), F.count("*").alias("units"))
    wanted = join_counted(units, best, ["family"], "units", units.count(), "inner").filter("kind = best").select("kind", "unit", "size", "blocks", "rounds")
    dealt = join_counted(held.select("kind", "unit", "rep", "label", "loose"), wanted, ["kind", "unit"], "size", held.count(), "inner")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    among = dealt.select("kind", "unit", part(F.col("blocks")).alias("i"), every("rounds").alias("j"), "rep", "label")
    asking = dealt.filter("loose").select("kind", "unit", every("blocks").alias("i"), part(F.col("rounds")).alias("j"), "rep", "label")
    groups = written(spark, among.union(asking).distinct(), "asking-candidates")
    return stars.union(_fetched(docs, groups).groupBy("kind", "unit", "i", "j").applyInArrow(_linked(percent), "a long, b long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; links at ``percent`` similarity or more."""
    feats = written(spark, features(docs, percent), "features")
    rows = feats.count()
    # equal sets: the smallest doc_id stands for all
    groups = written(spark, feats.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "groups")
    keys = feats.join(groups.select("set_a", "set_b", F.col("rep").alias("doc_id")), ["set_a", "set_b", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("weight").alias("n"), F.explode("bands").alias("band"))
    shared_bands = keys.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("head")).filter("size > 1")
    members = written(spark, join_counted(keys, shared_bands, ["band"], "size", rows * (BINS // band_rows(percent)), "inner").distinct(), "members")
    family = components(spark, members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")))
    reps = written(spark, members.select("rep", "n").distinct().join(family.select(F.col("node").alias("rep"), F.col("label").alias("family")), "rep"), "reps")
    weight = written(spark, reps.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "families")
    reps = written(spark, join_counted(reps, weight, ["family"], "size", reps.count(), "inner"), "weighed")  # family, rep, n, weight
    small = reps.filter(F.col("weight") <= GROUP_SHINGLES).select("family", "rep", F.lit(None).cast("long").alias("label"))
    links = _fetched(docs, small).groupBy("family").applyInArrow(_linked(percent), "a long, b long")
    large = reps.filter(F.col("weight") > GROUP_SHINGLES)
    if not large.isEmpty():
        links = links.union(_links_of_large(spark, docs, large, members, percent))
    label = components(spark, links.distinct())
    placed = groups.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("set_a", "set_b", "copies", F.coalesce("label", "rep").alias("label"))
    named = join_counted(feats.select("doc_id", "n_shingles", "set_a", "set_b"), placed, ["set_a", "set_b"], "copies", rows)
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("label"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document is kept, one per document."""
    gone = near_duplicates(spark, docs, percent=percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
